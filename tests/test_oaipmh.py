"""The data source against a local server: verbs, token chains, limits, errors, retries, streams."""

import gzip
import http.server
import json
import threading
import urllib.error
import urllib.parse

import pytest

from skerry import config
from skerry.sources import oaipmh
from skerry.sources.oaipmh import Chain, Client, OaiPmh, pages, retrying
from skerry.streaming import harvest


def rec(i):
    return f"<record><header><identifier>id{i}</identifier><datestamp>2020-01-0{i}</datestamp></header><metadata><dc><title>t{i}</title></dc></metadata></record>"


def reply(verb, inner):
    return f'<?xml version="1.0" encoding="UTF-8"?><OAI-PMH><{verb}>{inner}</{verb}></OAI-PMH>'


class Handler(http.server.BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
        self.server.seen.append(q)
        verb, token = q.get("verb"), q.get("resumptionToken")
        status, body = 200, ""
        if self.path.startswith("/busy") and len(self.server.seen) < 3:
            status = 503
        elif self.path.startswith("/gone"):
            status = 404
        elif self.path.startswith("/same"):
            body = reply("ListRecords", rec(1) + "<resumptionToken>again</resumptionToken>")
        elif self.path.startswith("/plain") and self.headers["Accept-Encoding"] != "identity":
            status = 500
        elif self.path.startswith("/wait"):
            body = '<?xml version="1.0"?><OAI-PMH><error code="InternalException">later</error></OAI-PMH>'
        elif self.path.startswith("/empty"):
            body = reply("ListRecords", f"<resumptionToken>n{len(self.server.seen)}</resumptionToken>")
        elif verb == "Identify":
            body = reply(verb, "<repositoryName>R &amp; D</repositoryName><baseURL>u</baseURL><earliestDatestamp>2020-01-01</earliestDatestamp><granularity>YYYY-MM-DD</granularity><adminEmail>a@x</adminEmail><adminEmail>b@x</adminEmail>")
        elif verb == "ListMetadataFormats":
            body = reply(verb, "".join(f"<metadataFormat><metadataPrefix>{p}</metadataPrefix><schema>s</schema><metadataNamespace>n</metadataNamespace></metadataFormat>" for p in ("oai_dc", "marc21")))
        elif verb == "ListSets":
            body = reply(verb, "<set><setSpec>set1</setSpec><setName>First Set</setName></set><set><setSpec>set2</setSpec><setName>Second Set</setName></set>")
        elif verb == "ListIdentifiers":
            body = reply(verb, '<header><identifier>id1</identifier><datestamp>2020-01-01</datestamp></header><resumptionToken completeListSize="100" cursor="100">x</resumptionToken>')
        elif verb == "GetRecord":
            body = reply(verb, rec(7))
        elif token is None and q.get("from", "") > "2020-01-05":
            body = '<?xml version="1.0"?><OAI-PMH><error code="noRecordsMatch">none</error></OAI-PMH>'
        else:
            n = int(token or 1)
            more = f'<resumptionToken completeListSize="3">{n + 1}</resumptionToken>' if n < 3 else "<resumptionToken/>"
            body = reply("ListRecords", rec(n) + more)
        data = gzip.compress(body.encode())
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)


@pytest.fixture
def server():
    found = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    found.seen = []
    threading.Thread(target=found.serve_forever, daemon=True).start()
    found.url = f"http://127.0.0.1:{found.server_address[1]}"
    yield found
    found.shutdown()


def load(spark, server, **options):
    spark.dataSource.register(OaiPmh)
    return spark.read.format("oaipmh").options(url=f"{server.url}/oai", delay="0.01", **options).load()


def test_verbs(spark, server):
    found = load(spark, server, verb="ListRecords").cache()
    assert sorted(r[0] for r in oaipmh.records(found).select("header.identifier").collect()) == ["id1", "id2", "id3"]
    assert [r["metadataPrefix"] for r in oaipmh.formats(load(spark, server, verb="ListMetadataFormats")).collect()] == ["oai_dc", "marc21"]
    sets = load(spark, server, verb="ListSets")
    assert [r["setName"] for r in oaipmh.sets(sets).collect()] == ["First Set", "Second Set"]
    size = oaipmh.complete_size(load(spark, server, verb="ListIdentifiers"))
    assert size.first()["size"] == 100
    assert oaipmh.identifiers(load(spark, server, verb="ListIdentifiers")).first()["identifier"] == "id1"
    assert oaipmh.records(load(spark, server, verb="GetRecord", identifier="x")).first()["header"]["identifier"] == "id7"
    who = load(spark, server, verb="Identify")
    assert oaipmh.identity(who).first()["repositoryName"] == "R & D"
    report = json.loads(oaipmh.report(who, oaipmh.formats(load(spark, server, verb="ListMetadataFormats")), oaipmh.sets(sets), size).first()["value"])
    assert report["size"] == 100 and report["identify"]["adminEmail"] == ["a@x", "b@x"] and len(report["sets"]) == 2


def test_intervals_are_partitions(spark, server):
    found = load(spark, server, unit="day", **{"from": "2020-01-01", "until": "2020-01-03"})
    assert found.rdd.getNumPartitions() == 3
    assert found.count() == 9


def test_identify_tells_where_intervals_begin(spark, server):
    found = load(spark, server, unit="day", until="2020-01-03").select("from_date", "page").collect()
    assert {r["from_date"] for r in found} == {"2020-01-01", "2020-01-02", "2020-01-03"}
    hours = load(spark, server, unit="hour", until="2020-01-02").select("from_date").distinct().collect()
    assert sorted(r[0] for r in hours) == ["2020-01-01", "2020-01-02"]  # it knows days only
    assert oaipmh._Stream({"url": f"{server.url}/oai"}).initialOffset() == {"next": "2020-01-01"}
    gone = {"url": f"{server.url}/gone,{server.url}/oai", "unit": "day", "until": "2020-01-02", "ignore_http_errors": "true"}
    assert [p.from_date for p in oaipmh._Reader(gone).partitions()] == ["2020-01-01", "2020-01-02"]
    with pytest.raises(urllib.error.HTTPError):
        oaipmh._Reader(gone | {"ignore_http_errors": "false"}).partitions()


def test_answers_that_must_be_plain(server):
    options = {"url": f"{server.url}/plain", "unit": "day", "until": "2020-01-01", "retries": "0"}
    (only,) = oaipmh._Reader(options).partitions()
    assert only.plain and oaipmh.Client.of(options, only).headers["Accept-Encoding"] == "identity"


def test_rate_is_shared_among_partitions():
    options = {"url": "a.org,b.org", "unit": "day", "from": "2020-01-01", "until": "2020-01-03", "rate": "600"}
    chains = oaipmh._Reader(options).partitions()
    assert len(chains) == 6 and {oaipmh.Client.of(options, c).throttle.rate for c in chains} == {100.0}
    few = options | {"parallel": "2"}
    assert {oaipmh.Client.of(few, c).throttle.rate for c in oaipmh._Reader(few).partitions()} == {300.0}
    stream = oaipmh._Stream(options).partitions({"next": "2020-01-01"}, {"next": "2020-01-04"})
    assert {c.share for c in stream} == {len(stream)}


def test_waits_are_bounded(server):
    waits = []
    options = {"delay": "0.01", "max_waits": "3"}
    got = list(pages(Client(options), options, Chain(server.url + "/wait", "", ""), sleep=waits.append))
    assert len(waits) == 3 and [r[8] for r in got] == ["InternalException"]


def chain(server, path, client=None, **options):
    options = {"delay": "0.01", "retries": "3"} | options
    return list(pages(client or Client(options), options, Chain(server.url + path, "", ""), wait=0.01))


def test_page_loop_stops(server):
    assert len(chain(server, "/same")) == 2
    assert len(chain(server, "/empty")) == 10
    assert len(chain(server, "/oai", max_requests="2")) == 2
    options = {"delay": "0.01"}
    none = list(pages(Client(options), options, Chain(server.url + "/oai", "2021-01-01", "2021-01-02")))
    assert len(none) == 1 and none[0][8] == "noRecordsMatch"


def test_errors(server):
    assert len(chain(server, "/busy")) == 3
    with pytest.raises(urllib.error.HTTPError):
        chain(server, "/gone")
    assert chain(server, "/gone", ignore_http_errors="true")[0][8] == "HTTP"


def test_retry_counts():
    calls = []

    def fails(times):
        calls.append(1)
        if len(calls) <= times:
            raise TimeoutError
        return "ok"

    waits = []
    assert retrying(lambda: fails(1), 2, 10, 2.0, sleep=waits.append) == "ok" and len(calls) == 2 and waits == [10]
    calls.clear()
    with pytest.raises(TimeoutError):
        retrying(lambda: fails(9), 2, 10, 2.0, sleep=waits.append)
    assert len(calls) == 3


def test_stream_resumes(spark, server, tmp_path):
    def run(today):
        stream = harvest.stream(spark, url=f"{server.url}/oai", unit="day", today=today, delay="0.01", **{"from": "2020-01-01"})
        harvest.store(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out")

    assert {str(r[0]) for r in run("2020-01-03").select("until_date").distinct().collect()} == {"2020-01-01", "2020-01-02"}
    again = run("2020-01-04")
    days = [str(r["until_date"]) for r in again.filter("page = 1").select("until_date").collect()]
    assert sorted(days) == ["2020-01-01", "2020-01-02", "2020-01-03"]


def test_config(monkeypatch):
    import io
    import logging

    monkeypatch.setenv("SKERRY_DIR", "/x")
    assert config.base_dir() == "/x"
    monkeypatch.delenv("SKERRY_DIR")
    monkeypatch.setenv("XDG_CACHE_HOME", "/c")
    assert config.base_dir() == "/c/skerry"
    assert config.list_flag(["a", "b"]) == "a, b"
    out = io.StringIO()
    log = logging.getLogger("skerry-test")
    log.addHandler(config.Tee(out))
    log.warning("w")
    log.info("i")
    assert out.getvalue() == "w\n"
