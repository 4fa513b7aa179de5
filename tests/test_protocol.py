"""Literal cases of the protocol's rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skerry.functions import protocol, text, urls
from skerry.plans import intervals
from skerry.sources.oaipmh import Offset, ProtocolError, request_url

REQUESTS = [
    ("", "Identify", "", "", "", "missing URL"),
    ("http://example.com", "x", "", "", "", "invalid verb"),
    ("http://example.com", "Identify", "", "", "", "http://example.com?verb=Identify"),
    ("http://example.com", "ListRecords", "", "", "", "missing parameter"),
    ("http://example.com", "ListRecords", "x", "", "", "http://example.com?metadataPrefix=x&verb=ListRecords"),
    ("http://example.com", "ListRecords", "x", "20", "", "http://example.com?from=20&metadataPrefix=x&verb=ListRecords"),
    ("http://example.com", "ListRecords", "x", "20", "1", "http://example.com?resumptionToken=1&verb=ListRecords"),
    ("http://example.com", "GetRecord", "x", "", "", "missing parameter"),
]


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize("base,verb,prefix,from_,token,want", REQUESTS)
def test_requests(spark, base, verb, prefix, from_, token, want):
    c, no = F.lit, F.lit("")
    url = protocol.request_url(c(base), c(verb), c(prefix), no, c(from_), no, no, c(token), c(False))
    error = protocol.request_error(c(base), c(verb), c(prefix), no, c(token), c(False))
    row = spark.range(1).select(url.alias("u"), error.alias("e")).first()
    assert want == (row["u"] or row["e"])
    try:
        twin = request_url(base, Offset(verb, prefix, "", "", False), from_, "", token)
    except ProtocolError as problem:
        twin = str(problem)
    assert twin == want


def test_directory_key(spark):
    key = protocol.directory_key(F.lit("testSet"), F.lit("testFormat"), F.lit("http://example.com"))
    assert one(spark, key) == "dGVzdFNldCN0ZXN0Rm9ybWF0I2h0dHA6Ly9leGFtcGxlLmNvbQ"
    assert one(spark, protocol.directory_parts(key)) == ["testSet", "testFormat", "http://example.com"]
    assert one(spark, protocol.directory_parts(F.lit("not a key!"))) is None


def test_scheme(spark):
    for url in ("example.com", "ftp://example.com", "localhost:8080"):
        assert one(spark, protocol.with_scheme(F.lit(url))) == "http://" + url
    assert one(spark, protocol.with_scheme(F.lit("https://x"))) == "https://x"


def test_page_names(spark):
    names = {"2020-01-15-00000001.xml.gz": "2020-01-15", "2020-01-15-00000001.xml.zst": "2020-01-15", "2020-01-15-00000001.xml": "2020-01-15", "2020-01-15-1.xml": None, "x.xml.gz": None, "2020-01-15-00000001.xml-tmp-1": None}
    for name, want in names.items():
        assert one(spark, protocol.page_date(F.lit(name))) == want


def test_layouts_and_earliest(spark):
    assert [one(spark, protocol.date_layout(F.lit(g))) for g in (protocol.DAY, protocol.SECOND, "invalid")] == ["2006-01-02", "2006-01-02T15:04:05Z", ""]
    cases = [("YYYY-MM-DD", "2020-01-01", dt.datetime(2020, 1, 1)), ("YYYY-MM-DDThh:mm:ssZ", "2020-01-01T12:30:45Z", dt.datetime(2020, 1, 1, 12, 30, 45)), ("invalid", "2020-01-01", None), ("YYYY-MM-DD", "2020-01-01T12:00:00Z", dt.datetime(2020, 1, 1))]
    for granularity, stamp, want in cases:
        assert one(spark, protocol.earliest_date(F.lit(granularity), F.lit(stamp))) == want


def test_rate_limits(spark):
    for limit, want in {"": 0, "0": 0, "1KB": 1024, "1.5m/s": 1.5 * 1024**2, "2 GB": 2 * 1024**3, "7": 7, "fast": None}.items():
        assert one(spark, protocol.rate_limit(F.lit(limit))) == want


def test_retry_predicate(spark):
    for status in (408, 429, 500, 502, 503, 504):
        assert one(spark, protocol.may_retry(F.lit(status), F.lit(None).cast("string"), F.lit(True)))
    for error in ("unexpected EOF", "connection refused", "no such host", "i/o timeout"):
        assert one(spark, protocol.may_retry(F.lit(None).cast("int"), F.lit(error), F.lit(True)))
    assert not one(spark, protocol.may_retry(F.lit(404), F.lit(None).cast("string"), F.lit(True)))
    assert not one(spark, protocol.may_retry(F.lit(503), F.lit(None).cast("string"), F.lit(False)))


def test_tokens(spark):
    empty = F.lit("")
    assert one(spark, protocol.next_token(F.lit("10"), F.lit("10"), F.lit("i"), empty, empty)) == ""
    assert one(spark, protocol.next_token(F.lit("10"), empty, empty, F.lit("r"), F.lit("s"))) == "r"
    assert one(spark, protocol.list_size(F.lit("100"))) == 100
    assert one(spark, protocol.list_size(F.lit("many"))) is None


def spans(spark, begin, end, unit):
    frame = spark.createDataFrame([(dt.datetime.fromisoformat(begin), dt.datetime.fromisoformat(end))], "begin timestamp, end timestamp")
    return [(str(r["from_ts"]), str(r["until_ts"])) for r in intervals.intervals(frame, unit).orderBy("from_ts").collect()]


def test_intervals(spark):
    days = spans(spark, "2016-01-01", "2016-01-03", "day")
    assert len(days) == 3 and days[-1][1] == "2016-01-03 23:59:59.999999"
    hours = spans(spark, "2016-01-02 17:00:00", "2016-01-02 19:00:00", "hour")
    assert len(hours) == 3 and hours[-1][1] == "2016-01-02 19:59:59.999999"
    months = spans(spark, "2016-01-31", "2016-03-10", "month")
    assert months == [("2016-01-31 00:00:00", "2016-01-31 23:59:59.999999"), ("2016-02-01 00:00:00", "2016-02-29 23:59:59.999999"), ("2016-03-01 00:00:00", "2016-03-10 00:00:00")]
    assert spans(spark, "2016-02-01", "2016-01-01", "day") == []


def test_resume(spark):
    frame = spark.createDataFrame([("2020-01-15", "2020-01-01", "2020-01-31"), (None, "2020-01-01", ""), ("2020-02-09", "2020-01-01", "")], "last_date string, earliest string, until string")
    got = [(r["from_date"], r["until_date"], r["synced"]) for r in intervals.plan(frame, F.lit("2020-02-10").cast("date")).collect()]
    assert got == [("2020-01-16", "2020-01-31", False), ("2020-01-01", "2020-02-09", False), ("2020-02-10", "2020-02-09", True)]


def test_identifiers(spark):
    ids = F.array(F.lit("https://ejournal.example.edu/article/view/1673"), F.lit("10.24246/ijpna.v3i1.29-35"), F.lit(""))
    found = one(spark, text.classify(ids, F.array(F.lit("ISSN 2550-0570"), F.lit("2549-046X"))))
    assert found.asDict() == {"urls": ["https://ejournal.example.edu/article/view/1673"], "doi": ["10.24246/ijpna.v3i1.29-35"], "issn": ["2550-0570", "2549-046X"]}


def test_control_and_charsets(spark):
    assert one(spark, text.without_control(F.lit("a\tb\x01c�d\ne\rf"))) == "abcd\ne\rf"
    body = "<?xml version='1.0' encoding='UTF-8'?><a>é</a>"
    frame = spark.createDataFrame([(bytearray(body.encode("latin-1")),), (bytearray(body.encode()),), (bytearray("é".encode("latin-1")),), (None,)], "b binary")
    assert [r[0] for r in frame.select(text.decode_with_fallback("b")).collect()] == [body, body, None, None]


def test_urls(spark):
    assert one(spark, urls.clean(F.lit("see http://x.org/a, and"))) == "http://x.org/a"
    assert one(spark, urls.clean(F.lit("www.example.com."))) == "http://www.example.com"
    assert one(spark, urls.clean(F.lit("http://https://x.org"))) == "https://x.org"
    assert one(spark, urls.scrub(F.lit("short"))) is None
    assert one(spark, urls.tld(F.lit("http://a.b.example.org:8080/x"))) == "org"
    assert one(spark, urls.tld(F.lit("http://127.0.0.1/x"))) == ""
    tags = one(spark, urls.tags(F.lit("http://opus.uni-x.edu.tr/dspace/ojs/"))).asDict()
    assert tags["platform"] == "opus" and tags["is_edu_world"] and tags["is_edu"]


def test_fortune(spark):
    said = text.fortune(F.array(F.lit("  One thing. Another.  ")), F.lit("http://x"), sentence=True)
    assert one(spark, said) == "One thing.\n\n    -- http://x"
    assert one(spark, text.fortune(F.array().cast("array<string>"), F.lit("x"))) is None
