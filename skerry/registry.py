"""Queries of the library's own operators on the driver's tables, with the SQL that gives the same rows.

pages where the query is about pages; URL operators run on ``pages``, statistics on whatever table fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import protocol, text, urls
from .operators import lists, providers, records
from .plans import intervals
from .sinks import pages as sink
from .sources import files, pages

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: oai, status, datestamp, set, and arrays by element."""
    d = t(spark, sf_dir, "documents")
    n, s = F.col("doc_id"), F.col("doc_id").cast("string")
    url = F.concat(F.lit("http://repo.example.org/"), s)
    return d.select(
        "doc_id",
        F.concat_ws(":", F.lit("oai"), "source", s).alias("oai"),
        F.when(n % 17 == 0, "deleted").alias("status"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (n % 1500).cast("int")), "yyyy-MM-dd").alias("datestamp"),
        F.col("lang").alias("set"),
        F.array(F.left("text", F.lit(80))).alias("title"),
        F.array("text").alias("description"),
        F.array(url, F.concat(F.lit("10."), (1000 + n % 50).cast("string"), F.lit("/x."), s), url, F.lit("")).alias("identifier"),
        F.array(F.concat(F.lit("Vol 2549-"), F.lpad((n % 10000).cast("string"), 4, "0"))).alias("source"),
        F.when(n % 3 == 0, F.array(F.lit("application/pdf"))).when(n % 3 == 1, F.array(F.lit("text/html"))).alias("format"),
        F.array(F.when(n % 2 == 0, "info:eu-repo/semantics/publishedVersion").otherwise("article")).alias("type"),
    )


_R = """r AS (SELECT doc_id, 'oai:' || source || ':' || doc_id AS oai, CASE WHEN doc_id % 17 = 0 THEN 'deleted' END AS status,
  strftime(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER), '%Y-%m-%d') AS datestamp, lang, left(text, 80) AS title, text,
  'http://repo.example.org/' || doc_id AS url, '10.' || (1000 + doc_id % 50) || '/x.' || doc_id AS doi,
  '2549-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS issn FROM documents)"""


def as_xml(rows: DataFrame) -> DataFrame:
    dc = {k: F.col(k) for k in ("title", "description", "identifier", "source", "format", "type")}
    return rows.select(F.col("oai").alias("key"), sink.record_xml(F.col("oai"), F.col("datestamp"), F.array("set"), dc, F.col("status")).alias("xml"))


def cached(spark: SparkSession, sf_dir: str) -> str:
    """The records as page files of one harvest; gives the root folder."""
    root = config.workspace(spark)
    key = spark.range(1).select(protocol.directory_key(F.lit(""), F.lit("oai_dc"), F.lit("http://repo.example.org/oai"))).first()[0]
    sink.write_pages(sink.as_pages(as_xml(harvested(spark, sf_dir))), f"{root}/{key}", "2024-12-31")
    return root


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records through XML, without files."""
    return pages.decode(as_xml(harvested(spark, sf_dir)).select("xml"))


def joined(c: str) -> Column:
    return F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live records and distinct DOIs of each set since a date, read from cached pages."""
    found = records.live(records.info(pages.read_pages(spark, cached(spark, sf_dir), "2020-06-01")))
    by_set = found.select(F.explode("sets").alias("set"), "oai", F.explode_outer("doi").alias("doi"))
    return by_set.groupBy("set").agg(F.count_distinct("oai").alias("records"), F.count_distinct("doi").alias("dois"))


query(
    "S3_flagship",
    f"WITH {_R} SELECT lang AS set, count(*) AS records, count(DISTINCT doi) AS dois FROM r WHERE status IS NULL AND datestamp >= '2020-06-01' GROUP BY lang",
)(flagship)


# Sources.


@query("S3_cached_pages", f"WITH {_R} SELECT oai, coalesce(status, '') AS status, datestamp, lang AS sets, CASE WHEN status IS NULL THEN title END AS title, CASE WHEN status IS NULL THEN text END AS description FROM r")
def s3(spark, sf_dir):
    found = pages.read_pages(spark, cached(spark, sf_dir))
    first = lambda e: F.get(records.element(e), F.lit(0)).alias(e)
    return found.select(F.col("header.identifier").alias("oai"), F.coalesce("header._status", F.lit("")).alias("status"), F.col("header.datestamp").alias("datestamp"), F.array_join("header.setSpec", "|").alias("sets"), first("title"), first("description"))


@query("S3_nested_records", "SELECT doc_id, 'r:' || doc_id AS oai, text, false AS corrupt FROM documents")
def s3_nested(spark, sf_dir):
    inner = F.concat(F.lit('<record xmlns="http://www.loc.gov/MARC21/slim"><datafield><subfield code="a">'), sink.escaped(F.col("text")), F.lit("</subfield></datafield></record>"))
    head = F.concat(F.lit("<record>\n<header>"), sink.element("identifier", F.concat(F.lit("r:"), "doc_id")), F.lit("</header><metadata>"))
    made = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat(head, inner, F.lit("</metadata></record>")).alias("xml"))
    root = config.workspace(spark)
    sink.write_pages(sink.as_pages(made), f"{root}/marc", "2024-12-31")
    found = pages.read_pages(spark, root)
    body = F.regexp_extract("metadata_xml", r'(?s)<subfield code="a">(.*)</subfield>', 1)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(char))
    oai = F.col("header.identifier")
    return found.select(F.split_part(oai, F.lit(":"), F.lit(2)).cast("long").alias("doc_id"), oai.alias("oai"), body.alias("text"), "corrupt")


@query("S8_split_records", f"WITH {_R} SELECT oai FROM r")
def s8(spark, sf_dir):
    texts = sink.as_pages(as_xml(harvested(spark, sf_dir)))
    cut = texts.select(F.explode(pages.split_records(F.concat("xml", F.lit("\n\n")))).alias("xml"))
    return cut.select(F.regexp_extract("xml", "<identifier>([^<]*)</identifier>", 1).alias("oai"))


@query("S10_endpoint_list", "SELECT url FROM pages WHERE trim(url) <> ''")
def s10(spark, sf_dir):
    path = config.workspace(spark)
    t(spark, sf_dir, "pages").select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("value")).unionByName(spark.range(3).select(F.lit("   ").alias("value"))).write.text(path)
    return files.endpoint_list(spark, path)


@query("S11_listing")
def s11(spark, sf_dir):
    return pages.page_files(spark, cached(spark, sf_dir)).select("name", "date", "bytes")


@query("S13_tsv", "SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders")
def s13(spark, sf_dir):
    path = config.workspace(spark)
    t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).write.option("sep", "\t").csv(path)
    return files.tsv(spark, path, "o_orderkey bigint, o_orderpriority string, day string", "day")


@query("S14_json_lines", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s14(spark, sf_dir):
    path = config.workspace(spark)
    t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.json(path)
    return files.json_lines(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


@query("S15_html_tables", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def s15(spark, sf_dir):
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> "), "n_name", F.lit("\n</td></tr>"))
    html = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<html><table><tr><th>key</th><th>name</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table></html>")).alias("html"))
    return files.html_tables(html, "html", ("key", "name"))


@query("S16_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def s16(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.explode(urls.hrefs(F.col("html"))).alias("href"))


@query("S18_report_csv", "SELECT s_suppkey, s_name FROM supplier")
def s18(spark, sf_dir):
    path = config.workspace(spark)
    t(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.option("header", "true").option("lineSep", "\r").csv(path)
    return files.report_csv(spark, path, "s_suppkey bigint, s_name string")


@query("S19_cache_path", "SELECT url, sha1(url)[1:2] || '/' || sha1(url)[3:4] || '/' || sha1(url)[5:6] || '/' || sha1(url)[7:] AS path FROM pages")
def s19(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("url", protocol.cache_path(F.col("url")).alias("path"))


@query("S5_compression", "SELECT url, CASE WHEN page_id % 2 = 0 THEN 'zstd' ELSE 'gzip' END AS codec FROM pages")
def s5(spark, sf_dir):
    name = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".zst").when(F.col("page_id") % 3 == 0, ".gz").otherwise(".bin"))
    return t(spark, sf_dir, "pages").select("url", protocol.compression(name).alias("codec"))


# Sinks.


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "K5_xml_records",
    f"""WITH {_R} SELECT oai, '<record><header><identifier>' || {_escaped("oai")} || '</identifier><datestamp>' || datestamp || '</datestamp><setSpec>' || lang || '</setSpec></header>'
  || '<metadata><oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>' || {_escaped("replace(title, chr(10), ' ')")}
  || '</dc:title></oai_dc:dc></metadata></record>' AS value FROM r""",
)
def k5(spark, sf_dir):
    rows = harvested(spark, sf_dir)
    title = F.transform("title", lambda v: F.replace(v, F.lit("\n"), F.lit(" ")))
    xml = rows.select("oai", sink.record_xml(F.col("oai"), F.col("datestamp"), F.array("set"), {"title": title}).alias("xml"))
    return xml.select("oai", F.regexp_replace("xml", "\n", " ").alias("value"))


@query("K6_json_records", f"WITH {_R} SELECT oai AS a, datestamp AS b, lang AS c FROM r WHERE status IS NULL")
def k6(spark, sf_dir):
    lines = records.live(records.info(decoded(spark, sf_dir))).select(F.to_json(F.struct("oai", "datestamp", "sets")).alias("value"))
    return lines.select(F.get_json_object("value", "$.oai").alias("a"), F.get_json_object("value", "$.datestamp").alias("b"), F.get_json_object("value", "$.sets[0]").alias("c"))


@query("P7_metadata_json", f"WITH {_R} SELECT oai, title, text AS description FROM r WHERE status IS NULL")
def p7(spark, sf_dir):
    lines = sink.json_lines(decoded(spark, sf_dir).filter("metadata_xml is not null"))
    at = lambda path: F.get_json_object("value", path)
    return lines.select(at("$.header.identifier").alias("oai"), at("$.metadata.dc.title").alias("title"), at("$.metadata.dc.description").alias("description"))


@query("K10_markdown", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def k10(spark, sf_dir):
    lines = sink.markdown(t(spark, sf_dir, "region").select("r_regionkey", "r_name")).split("\n")[2:]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("K9_csv_export", "SELECT p_partkey, p_name, p_retailprice FROM part")
def k9(spark, sf_dir):
    path = config.workspace(spark)
    t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.option("header", "true").csv(path)
    return spark.read.schema("p_partkey bigint, p_name string, p_retailprice double").option("header", "true").csv(path)


@query("K11_pack", f"WITH {_R} SELECT count(*) AS n, count(DISTINCT oai) AS distinct_oai FROM r")
def k11(spark, sf_dir):
    root = cached(spark, sf_dir)
    sink.pack(spark, root)
    return lists.distinct_counts(pages.read_pages(spark, root).select(F.col("header.identifier").alias("oai")), "oai")


@query("K11_pack_statistics", "SELECT o_custkey AS k, count(*) AS files, CAST(sum(o_orderkey) AS BIGINT) AS bytes, count(*) >= 3 AS packed, CASE WHEN count(*) >= 3 THEN (count(*) - 1) * 4096 ELSE 0 END AS saved FROM orders GROUP BY 1")
def k11_statistics(spark, sf_dir):
    listing = t(spark, sf_dir, "orders").select(F.concat_ws("/", F.lit("/x"), "o_custkey", "o_orderkey").alias("path"), F.col("o_orderkey").alias("bytes"))
    return sink.pack_statistics(listing).select(F.regexp_extract("directory", r"(\d+)$", 1).cast("long").alias("k"), "files", "bytes", "packed", "saved")


@query("K12_recompress", f"WITH {_R} SELECT oai FROM r")
def k12(spark, sf_dir):
    import pyarrow as pa
    import zstandard

    end = pages.END.encode()

    def plain(batches):  # reads the zstd bytes back, a response at a time, only in this query
        for b in batches:
            for body in b.column(0):
                rest = b""
                with zstandard.ZstdDecompressor().stream_reader(body.as_buffer(), read_across_frames=True) as source:
                    while part := source.read(1 << 20):
                        *found, rest = (rest + part).split(end)
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], ["value"])
                yield pa.RecordBatch.from_arrays([pa.array([rest.decode()])], ["value"])

    bodies = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml.gz").load(cached(spark, sf_dir)).select("path", "content")
    texts = sink.one_by_one(sink.recompress(bodies).select("content"), plain, "value string")
    again = texts.select(F.explode(pages.split_records(F.col("value"))).alias("xml"))
    return again.select(F.regexp_extract("xml", "<identifier>([^<]*)</identifier>", 1).alias("oai"))


# Projections.

_INFO = f"""WITH {_R} SELECT oai, coalesce(status, '') AS status, datestamp, lang AS sets,
  CASE WHEN status IS NULL THEN url || '|' || doi ELSE '' END AS ids, CASE WHEN status IS NULL THEN url ELSE '' END AS urls,
  CASE WHEN status IS NULL THEN doi ELSE '' END AS doi, CASE WHEN status IS NULL THEN issn ELSE '' END AS issn,
  CASE WHEN status IS NULL THEN title ELSE '' END AS titles FROM r"""


@query("P1_P2_P3_info", _INFO)
def p2(spark, sf_dir):
    found = records.info(decoded(spark, sf_dir))
    return found.select("oai", F.coalesce("status", F.lit("")).alias("status"), "datestamp", *map(joined, ("sets", "ids", "urls", "doi", "issn", "titles")))


@query("P4_doi", r"SELECT l_orderkey, l_linenumber, regexp_extract('see doi:10.' || l_orderkey || '/a.' || l_linenumber || ' there', '10\.[0-9]{1,8}/\S+', 0) AS doi FROM lineitem")
def p4(spark, sf_dir):
    said = F.concat(F.lit("see doi:10."), "l_orderkey", F.lit("/a."), "l_linenumber", F.lit(" there"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.first_doi(said).alias("doi"))


@query("P5_issn", "SELECT doc_id, regexp_extract(text, '[0-9]{4}-?[0-9]{3}[0-9xX]', 0) AS issn FROM documents")
def p5(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.first_issn(F.col("text")).alias("issn"))


@query("P6_append_unique", "SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '' ELSE '|x' END AS urls FROM pages")
def p6(spark, sf_dir):
    value = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("x")
    return t(spark, sf_dir, "pages").select("page_id", text.append_unique(F.array("url"), value).alias("urls")).select("page_id", joined("urls"))


@query("P8_control", "SELECT doc_id, text FROM documents")
def p8(spark, sf_dir):
    dirty = F.concat(F.lit("\t\x01"), "text", F.lit("\x1f�\x0b"))
    return t(spark, sf_dir, "documents").select("doc_id", text.without_control(dirty).alias("text"))


@query("P9_charset", "SELECT doc_id, text FROM documents")
def p9(spark, sf_dir):
    declared = F.concat(F.lit("<?xml version='1.0' encoding='UTF-8'?>"), "text")
    latin = F.concat(F.lit("<?xml version='1.0' encoding='UTF-8'?>"), F.regexp_replace("text", "[^\\x00-\\xff]", "?"))
    fits = ~F.col("text").rlike("[^\\x00-\\xff]") & F.col("text").rlike("[\\x80-\\xff][A-Za-z ]")
    body = F.when((F.col("doc_id") % 2 == 0) & fits, F.encode(latin, "ISO-8859-1")).otherwise(F.encode(declared, "UTF-8"))
    found = t(spark, sf_dir, "documents").select("doc_id", text.decode_with_fallback(body).alias("text"))
    return found.withColumn("text", F.substring("text", 39, 1 << 30))


@query("P11_scheme", "SELECT page_id, 'http://' || replace(url, 'https://', 'ftp://') AS url FROM pages WHERE url LIKE 'https://%' UNION ALL SELECT page_id, CASE WHEN url LIKE 'http%' THEN url ELSE 'http://' || url END FROM pages WHERE url NOT LIKE 'https://%'")
def p11(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", protocol.with_scheme(F.replace("url", F.lit("https://"), F.lit("ftp://"))).alias("url"))


@query("P12_directory_key", "SELECT url, rtrim(replace(replace(to_base64(encode('s#oai_dc#' || url)), '+', '-'), '/', '_'), '=') AS k FROM pages")
def p12(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("url", protocol.directory_key(F.lit("s"), F.lit("oai_dc"), F.col("url")).alias("k"))


@query("P13_directory_parts", "SELECT 's' || page_id AS a, 'oai_dc' AS b, url AS c FROM pages")
def p13(spark, sf_dir):
    key = protocol.directory_key(F.concat(F.lit("s"), "page_id"), F.lit("oai_dc"), F.col("url"))
    parts = t(spark, sf_dir, "pages").select(protocol.directory_parts(key).alias("p"))
    return parts.select(*(F.get("p", F.lit(i)).alias(c) for i, c in enumerate("abc")))


@query("P14_ellipsis", "SELECT page_id, CASE WHEN strlen(url) > 35 THEN left(url, 35) || '...' ELSE url END AS name FROM pages")
def p14(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", protocol.ellipsis(F.col("url")).alias("name"))


@query("P15_page_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def p15(spark, sf_dir):
    suffix = F.when(F.col("o_orderkey") % 3 == 0, ".xml.gz").when(F.col("o_orderkey") % 3 == 1, ".xml").otherwise(".xml-tmp-1")
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-00000001"), suffix)
    return t(spark, sf_dir, "orders").select("o_orderkey", protocol.page_date(name).alias("day"))


@query(
    "P16_request_url",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '?verb=Identify' WHEN page_id % 4 = 1 THEN url || '?resumptionToken=a%21b+c&verb=ListRecords'
  WHEN page_id % 4 = 2 THEN url || '?from=2020-01-01&metadataPrefix=oai_dc&set=s&until=2020-02-01&verb=ListRecords' END AS request,
  CASE WHEN page_id % 4 = 3 THEN 'missing parameter' END AS error FROM pages""",
)
def p16(spark, sf_dir):
    kind = F.col("page_id") % 4
    verb = F.when(kind == 0, "Identify").otherwise("ListRecords")
    prefix = F.when(kind == 2, "oai_dc")
    token = F.when(kind == 1, "a!b c")
    no, off = F.lit(None).cast("string"), F.lit(False)
    request = protocol.request_url(F.col("url"), verb, prefix, no, F.lit("2020-01-01"), F.lit("2020-02-01"), F.lit("s"), token, off)
    return t(spark, sf_dir, "pages").select("page_id", request.alias("request"), protocol.request_error(F.col("url"), verb, prefix, no, token, off).alias("error"))


@query("P17_P18_tokens", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '' WHEN l_linenumber % 3 = 0 THEN 'i' ELSE 'r' END AS token, CASE WHEN l_linenumber % 3 = 0 THEN 's' ELSE 'z' END AS first, CAST(l_orderkey AS BIGINT) AS size FROM lineitem")
def p17(spark, sf_dir):
    n, size = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    token = protocol.next_token(size, F.when(n % 2 == 0, size).otherwise("x"), F.when(n % 3 == 0, "i"), F.lit("r"), F.lit("s"))
    first = protocol.first_of(F.when(n % 3 == 0, "s"), F.lit(""), F.lit("z"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", token.alias("token"), first.alias("first"), protocol.list_size(size).alias("size"))


@query("P19_P20_dates", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2006-01-02' WHEN event_id % 3 = 1 THEN '2006-01-02T15:04:05Z' ELSE '' END AS layout, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) WHEN event_id % 3 = 1 THEN date_trunc('second', ts) END AS earliest FROM events")
def p19(spark, sf_dir):
    kind = F.col("event_id") % 3
    granularity = F.when(kind == 0, protocol.DAY).when(kind == 1, protocol.SECOND).otherwise("bad")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    found = t(spark, sf_dir, "events").select("event_id", protocol.date_layout(granularity).alias("layout"), protocol.earliest_date(granularity, stamp).alias("earliest"))
    return found.withColumn("earliest", F.col("earliest").cast("timestamp_ntz"))


@query("P21_rate", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 1024.0 WHEN 1 THEN p_size * 1048576.0 WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE NULL END AS rate FROM part")
def p21(spark, sf_dir):
    unit = F.when(F.col("p_size") % 4 == 0, "KB/s").when(F.col("p_size") % 4 == 1, "m").when(F.col("p_size") % 4 == 2, "").otherwise(" parsecs")
    return t(spark, sf_dir, "part").select("p_partkey", protocol.rate_limit(F.concat(F.col("p_size").cast("string"), unit)).alias("rate"))


@query("P22_scrub", "SELECT page_id, CASE WHEN strlen(url) BETWEEN 10 AND 120 THEN url END AS url FROM pages")
def p22(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.replace("url", F.lit("/"), F.lit(" &#47;\t")), F.lit(" "))
    return t(spark, sf_dir, "pages").select("page_id", text.unescape(raw).alias("raw")).select("page_id", urls.scrub(F.col("raw")).alias("url"))


@query("P23_P24_clean", "SELECT page_id, url, TRUE AS valid FROM pages")
def p23(spark, sf_dir):
    raw = F.concat(F.lit("see <"), "url", F.lit(">, please."))
    found = t(spark, sf_dir, "pages").select("page_id", urls.clean(raw).alias("url"))
    return found.withColumn("valid", urls.is_valid(F.col("url")))


_TLD = "regexp_extract(split_part(split_part(url, '/', 3), ':', 1), '([^.]*)$', 1)"


@query("P25_tld", f"SELECT page_id, CASE WHEN regexp_matches({_TLD}, '^[a-z]{{2,20}}') THEN {_TLD} ELSE '' END AS tld FROM pages")
def p25(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.tld(F.col("url")).alias("tld"))


@query(
    "P26_tags",
    """WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '/ojs/x' WHEN 1 THEN 'http://museum.gov.id/dspace' WHEN 2 THEN 'http://a.edu.tr/opus.x' WHEN 3 THEN 'http://b.edu/' WHEN 4 THEN 'http://lib.sfu.ca/' ELSE url END AS url FROM pages)
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ojs' WHEN 1 THEN 'dspace' WHEN 2 THEN 'opus' ELSE '' END AS platform,
  page_id % 6 IN (2, 3, 4) OR regexp_matches(url, 'uni-|[.]uni[.]|univ-|[/.]u[a-z]{2,8}.(br|ca|es)|uni.*[.](it|hr|ch|nl|ua|hu|fr|gr)|uni.*.hr|uni.*no|thesis|theses|[.](edu|ac)[.][a-z]{2,3}|casirgrid') AS is_edu,
  page_id % 6 = 1 AS is_museum, page_id % 6 = 1 AS is_gov, page_id % 6 = 1 OR contains(url, '.id/') OR contains(url, 'jurnal') AS is_id FROM u""",
)
def p26(spark, sf_dir):
    kind, url = F.col("page_id") % 6, F.col("url")
    made = F.when(kind == 0, F.concat(url, F.lit("/ojs/x"))).when(kind == 1, "http://museum.gov.id/dspace").when(kind == 2, "http://a.edu.tr/opus.x").when(kind == 3, "http://b.edu/").when(kind == 4, "http://lib.sfu.ca/").otherwise(url)
    return t(spark, sf_dir, "pages").select("page_id", urls.tags(made).alias("t")).select("page_id", "t.platform", "t.is_edu", "t.is_museum", "t.is_gov", "t.is_id")


@query("P27_guess", "SELECT page_id, rtrim(url, '/') || CASE page_id % 4 WHEN 0 THEN '/oai' WHEN 1 THEN '/oai/request' WHEN 2 THEN '/cgi/oai2' END AS guess FROM pages")
def p27(spark, sf_dir):
    kind = F.col("page_id") % 4
    system = F.when(kind == 0, "OJS").when(kind == 1, "DSpace XOAI").when(kind == 2, "Eprints 3").otherwise("Pure")
    return t(spark, sf_dir, "pages").select("page_id", urls.endpoint_guess(system, F.concat("url", F.lit("/"))).alias("guess"))


@query("P28_P30_journals", "SELECT page_id, url || '/oai' AS a, url || '/index.php/j/oai' AS b, url || '/index.php/j/oai' AS c FROM pages")
def p28(spark, sf_dir):
    url = F.col("url")
    journal = F.concat(url, F.lit("/index.php/j"))
    return t(spark, sf_dir, "pages").select("page_id", urls.journal_endpoint(F.concat(url, F.lit("/index"))).alias("a"), urls.ojs_endpoint(journal).alias("b"), urls.article_endpoint(F.concat(journal, F.lit("/article/view/1"))).alias("c"))


@query("P29_P40_links", """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, 'http://x.org' || href AS link FROM (SELECT DISTINCT page_id, split_part(href, '?', 1) AS href FROM h)""")
def p40(spark, sf_dir):
    absolute = F.regexp_replace("html", 'href="', 'href="http://x.org')
    return t(spark, sf_dir, "pages").select("page_id", F.explode(urls.outside_links(absolute)).alias("link"))


@query("P29_journal_links", "SELECT page_id, url || '/index.php/a/oai' AS link FROM pages")
def p29(spark, sf_dir):
    html = F.concat(F.lit('<a href="'), "url", F.lit('/index.php/a/"></a><a href="/about"></a><a href="'), "url", F.lit('/index.php/a?searchInitial=b"></a>'))
    return t(spark, sf_dir, "pages").select("page_id", F.explode(urls.journal_links(html)).alias("link"))


@query("P31_article_links", "SELECT DISTINCT 'http://j.org/index.php/j' || (o_custkey % 50) || '/oai' AS oai FROM orders")
def p31(spark, sf_dir):
    link = F.concat(F.lit("http://j.org/index.php/j"), F.col("o_custkey") % 50, F.lit("/article/view/"), "o_orderkey")
    return t(spark, sf_dir, "orders").select(urls.article_endpoint(link).alias("oai")).filter("oai is not null").distinct()


_PROVIDER = "SELECT s_suppkey AS k, s_name AS name, 'http://x.org/' || s_suppkey AS url, 'Europe' AS continent, CASE WHEN s_suppkey % 2 = 0 THEN 'OJS' END AS system, CAST(s_suppkey AS VARCHAR) AS document_count, s_suppkey || ' (' || (s_suppkey % 100) || '%)' AS open_access_info, CASE WHEN s_suppkey % 3 = 0 THEN 'https://ror.org/0' || s_suppkey END AS ror FROM supplier"


@query("P32_providers", _PROVIDER)
def p32(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    details = F.concat(
        F.lit("URL:\n http://x.org/"), k, F.lit("\nContinent:  Europe\nNumber of documents: "), k, F.lit("\ndavon Open Access: "), k, F.lit(" ("), (F.col("s_suppkey") % 100).cast("string"), F.lit("%)\n"),
        F.when(F.col("s_suppkey") % 2 == 0, "System: OJS\n").otherwise(""), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("ROR: https://ror.org/0"), k, F.lit("\n"))).otherwise(""),
    )
    entries = t(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), "s_name", F.lit("\n Further information ?")).alias("name"), details.alias("details"))
    return providers.providers(entries).select(F.col("document_count").cast("long").alias("k"), "name", "url", "continent", "system", "document_count", "open_access_info", "ror")


@query("P33_fortune", "SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10)) <> '' THEN trim(text, ' ' || chr(10)) || chr(10) || chr(10) || '    -- ' || source END AS said FROM documents")
def p33(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.fortune(F.array("text"), F.col("source")).alias("said"))


@query("P35_snippet", r"SELECT doc_id, CASE WHEN length(text) < 120 THEN f ELSE '[' || length(text) || '] ' || left(f, 50) || ' ... ' || right(f, 50) END AS said FROM (SELECT doc_id, text, regexp_replace(text, '\s*\n\s*', ' ', 'g') AS f FROM documents)")
def p35(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("said"))


@query("P34_basic_auth", "SELECT c_custkey, 'Basic ' || to_base64(encode(c_name || ':' || c_mktsegment)) AS header FROM customer")
def p34(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", protocol.basic_auth(F.col("c_name"), F.col("c_mktsegment")).alias("header"))


@query("P36_P37_cleanup", "SELECT page_id, url AS a, url || '|http://b.org' AS b FROM pages")
def p36(spark, sf_dir):
    dirty = F.concat(F.lit(urls.SHARE_PREFIX), "url", F.lit("?verb=Identify"))
    two = F.concat(F.lit(" "), "url", F.lit("\t b.org "))
    return t(spark, sf_dir, "pages").select("page_id", urls.site_cleanup(dirty).alias("a"), F.array_join(urls.tokens(two), "|").alias("b"))


@query("P38_P39_reports", "SELECT page_id, url || '/index.php/j/oai' AS a, 'http://e.org/en/journal/x' || page_id || '/oai' AS b FROM pages")
def p38(spark, sf_dir):
    line = F.concat(F.lit("a\tb\tc\td\t"), "url", F.lit("/index.php/j/index\tf"))
    html = F.concat(F.lit("<a href='/en/journal/x"), "page_id", F.lit("'>x</a>"))
    return t(spark, sf_dir, "pages").select("page_id", urls.report_endpoint(line).alias("a"), F.get(urls.journal_paths(html, "http://e.org"), F.lit(0)).alias("b"))


# Filters.


@query("F1_date_range", f"WITH {_R} SELECT oai, datestamp FROM r WHERE datestamp >= '2020-03-01' AND datestamp <= '2021-01-31'")
def f1(spark, sf_dir):
    return pages.in_range(decoded(spark, sf_dir), "2020-03-01", "2021-01-31").select("header.identifier", "header.datestamp").withColumnRenamed("identifier", "oai")


@query("F2_file_pruning", f"WITH {_R} SELECT oai, datestamp FROM r WHERE datestamp >= '2022-01-01'")
def f2(spark, sf_dir):
    root = config.workspace(spark)
    made = as_xml(harvested(spark, sf_dir)).withColumn("datestamp", F.regexp_extract("xml", "<datestamp>([^<]*)<", 1))
    for year in range(2020, 2025):  # harvests by years: the files' names, not the filter, leave out the first two
        sink.write_pages(sink.as_pages(made.filter(F.col("datestamp").startswith(str(year)))), f"{root}/{year}", f"{year}-12-31")
    found = pages.raw_records(spark, root, "2022-01-01")
    return found.select(*(F.regexp_extract("xml", f"<{tag}>([^<]*)<", 1).alias(c) for tag, c in (("identifier", "oai"), ("datestamp", "datestamp"))))


@query("F4_F5_live", f"WITH {_R} SELECT oai FROM r WHERE status IS NULL")
def f4(spark, sf_dir):
    return records.live(records.info(decoded(spark, sf_dir))).select("oai")


@query("F6_find", "SELECT DISTINCT url FROM pages WHERE contains(url, 'example')")
def f6(spark, sf_dir):
    return pages.find_endpoints(t(spark, sf_dir, "pages"), "example")


_BLOCKED = {k: "[" + ", ".join(f"'{p}'" for p in v) + "]" for k, v in (("id", records.ID_BLOCKLIST), ("url", records.URL_BLOCKLIST))}


@query(
    "F7_block_lists",
    f"""WITH b AS (SELECT {_BLOCKED['id']} AS i, {_BLOCKED['url']} AS u), x AS (SELECT doc_id,
      CASE WHEN doc_id % 3 = 0 THEN upper(i[doc_id % len(i) + 1]) || doc_id ELSE 'oai:x:' || doc_id END AS oai,
      'http' || CASE WHEN doc_id % 4 = 0 THEN u[doc_id % len(u) + 1] ELSE '://example.org/' END || doc_id AS url, i, u FROM documents, b)
      SELECT doc_id, oai, len(list_filter(i, lambda p: starts_with(lower(oai), p))) > 0 AS blocked_id, len(list_filter(u, lambda p: contains(url, p))) > 0 AS blocked_url FROM x""",
)
def f7(spark, sf_dir):
    n = F.col("doc_id")
    nth = lambda of: F.get(F.array(*map(F.lit, of)), (n % len(of)).cast("int"))
    oai = F.when(n % 3 == 0, F.concat(F.upper(nth(records.ID_BLOCKLIST)), n)).otherwise(F.concat(F.lit("oai:x:"), n))
    url = F.concat(F.lit("http"), F.when(n % 4 == 0, nth(records.URL_BLOCKLIST)).otherwise("://example.org/"), n)
    made = t(spark, sf_dir, "documents").select("doc_id", oai.alias("oai"), url.alias("url"))
    return made.select("doc_id", "oai", records.blocked_id(F.col("oai")).alias("blocked_id"), records.blocked_url(F.col("url")).alias("blocked_url"))


@query("F8_formats", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 1")
def f8(spark, sf_dir):
    return harvested(spark, sf_dir).filter(records.may_be_pdf(F.col("format"))).select("doc_id")


@query("F10_J2_block_list", "SELECT url FROM pages WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'example.' || x AS p FROM (VALUES ('net'), ('org')) AS v(x)) WHERE contains(url, p))")
def f10(spark, sf_dir):
    patterns = spark.createDataFrame([("example.net",), ("example.org",)], "pattern string")
    return lists.without_matches(t(spark, sf_dir, "pages").select("url"), patterns)


@query("F11_date_comparison", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-11-01'")
def f11(spark, sf_dir):
    return t(spark, sf_dir, "orders").filter(F.to_date("o_orderdate") > F.lit("1996-11-01").cast("date")).select("o_orderkey")


@query("F12_json_predicate", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def f12(spark, sf_dir):
    return t(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").cast("int") >= 50).select("event_id")


@query("F13_retry", "SELECT p_partkey, p_size % 7 IN (1, 2, 4) AS again FROM part")
def f13(spark, sf_dir):
    kind = F.col("p_size") % 7
    status = F.when(kind == 1, 503).when(kind == 2, 429).when(kind == 3, 404)
    error = F.when(kind == 4, "unexpected EOF").when(kind == 5, "bad certificate")
    return t(spark, sf_dir, "part").select("p_partkey", protocol.may_retry(status, error, F.lit(True)).alias("again"))


# Joins and set operations.


@query("J1_prefer_https", "WITH u AS (SELECT DISTINCT split_part(url, '://', 2) AS rest, page_id % 2 = 0 AS secure FROM pages UNION SELECT split_part(url, '://', 2), page_id % 3 = 0 FROM pages) SELECT CASE WHEN bool_or(secure) THEN 'https://' ELSE 'http://' END || rest AS url FROM u GROUP BY rest")
def j1(spark, sf_dir):
    rest = F.regexp_replace("url", "^https?://", "")
    p = t(spark, sf_dir, "pages")
    a = p.select(F.concat(F.when(F.col("page_id") % 2 == 0, "https://").otherwise("http://"), rest).alias("url"))
    b = p.select(F.concat(F.when(F.col("page_id") % 3 == 0, "https://").otherwise("http://"), rest).alias("url"))
    return lists.prefer_https(a.unionByName(b))


@query("J3_common", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j3(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lists.common(t(spark, sf_dir, "customer"), orders, "c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("J4_only_first", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j4(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return lists.only_first(t(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey")


@query("J5_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j5(spark, sf_dir):
    nation = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return lists.lookup(t(spark, sf_dir, "supplier"), nation, "s_nationkey").select("s_suppkey", "n_name")


@query("U1_U2_distinct", "SELECT DISTINCT text FROM documents")
def u1(spark, sf_dir):
    return records.distinct_records(t(spark, sf_dir, "documents").select("text"))


@query("U3_U5_merged", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u3(spark, sf_dir):
    return lists.merged(t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("U4_intersect_except", "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'first', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def u4(spark, sf_dir):
    a, b = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").unionByName(a.subtract(b).select(F.lit("first").alias("kind"), "k"))


@query("U6_latest", f"WITH {_R} SELECT lang AS oai, max(datestamp) AS datestamp FROM r GROUP BY lang")
def u6(spark, sf_dir):
    return records.latest(harvested(spark, sf_dir).select(F.col("set").alias("oai"), "datestamp"))


_E1 = f"""WITH {_R} SELECT url AS base_url, doi, oai, CASE WHEN doc_id % 2 = 0 THEN 'published' END AS release_stage FROM r WHERE status IS NULL AND doc_id % 3 <> 1"""


@query("E1_ingest", _E1)
def e1(spark, sf_dir):
    found = records.ingest_requests(records.info(decoded(spark, sf_dir)))
    return found.select("base_url", "ext_ids.doi", "ext_ids.oai", "release_stage")


# Aggregations, sorts and limits.


@query("A1_top_counts", f"SELECT {_TLD} AS tld, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, tld LIMIT 25")
def a1(spark, sf_dir):
    return lists.top_counts(lists.sites(t(spark, sf_dir, "pages")), "tld", k=25)


@query("A2_counts_by_keys", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def a2(spark, sf_dir):
    return lists.count_by(t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("A3_counts_by_country", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 20")
def a3(spark, sf_dir):
    nation = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lists.top_counts(lists.lookup(t(spark, sf_dir, "customer"), nation, "c_nationkey", "inner"), "n_name", k=20)


@query("A4_top_sums", "SELECT k, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS nth FROM orders) JOIN (VALUES (3), (5), (10), (20)) AS v(k) ON nth <= k GROUP BY k")
def a4(spark, sf_dir):
    return lists.top_sums(t(spark, sf_dir, "orders"), "o_orderkey")


@query("A5_sum", "SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part")
def a5(spark, sf_dir):
    return t(spark, sf_dir, "part").agg(F.sum("p_size").alias("total"))


@query("A6_counters", f"WITH {_R} SELECT count(*) AS total, count(status) AS deleted, CAST(0 AS BIGINT) AS skipped, count(*) - count(status) AS encoded FROM r")
def a6(spark, sf_dir):
    return records.counters(records.info(decoded(spark, sf_dir)))


@query("A7_hosts", "SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages GROUP BY 1")
def a7(spark, sf_dir):
    return lists.host_histogram(t(spark, sf_dir, "pages"))


@query("A7_tlds", f"SELECT {_TLD} AS tld, count(*) AS n FROM pages GROUP BY 1")
def a7_tlds(spark, sf_dir):
    return lists.tld_histogram(t(spark, sf_dir, "pages"))


@query("A8_distinct_counts", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS distinct_o_custkey, count(DISTINCT o_orderpriority) AS distinct_o_orderpriority FROM orders")
def a8(spark, sf_dir):
    return lists.distinct_counts(t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("A9_last_date", "SELECT coalesce(max(strftime(ts, '%Y-%m-%d')), '1970-01-01') AS last FROM events")
def a9(spark, sf_dir):
    return lists.last_date(t(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date")), "1970-01-01")


@query("A11_list_size", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS size FROM orders")
def a11(spark, sf_dir):
    size = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("many")
    return t(spark, sf_dir, "orders").select("o_orderkey", protocol.list_size(size).alias("size"))


@query("A12_url_kinds", r"WITH u AS (SELECT url || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '/index.php/j' ELSE '' END AS url FROM pages) SELECT regexp_extract(split_part(split_part(url, '/', 3), ':', 1), '([^.]*\.[^.]*|^[^.]*)$', 1) AS domain, count(*) AS urls, count(*) FILTER (url LIKE '%.pdf') AS pdf, count(*) FILTER (url LIKE '%/index.php/%') AS journal FROM u GROUP BY 1")
def a12(spark, sf_dir):
    kind = F.col("page_id") % 3
    return lists.url_kinds(t(spark, sf_dir, "pages").select(F.concat("url", F.when(kind == 0, ".pdf").when(kind == 1, "/index.php/j").otherwise("")).alias("url")))


@query("A13_repeated_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def a13(spark, sf_dir):
    return lists.repeated_keys(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query("A14_counts_over_time", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def a14(spark, sf_dir):
    return lists.count_by(t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")), "month")


@query("O1_O2_order", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_orderkey AS VARCHAR) AS name FROM orders ORDER BY 1, 2")
def o2(spark, sf_dir):
    return lists.by_date_then_name(t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").cast("string").alias("name")))


@query("O4_top_k", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o4(spark, sf_dir):
    return t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


@query("O5_sample", "SELECT page_id, url FROM pages ORDER BY md5('7:' || page_id), page_id LIMIT 20")
def o5(spark, sf_dir):
    return lists.sample(t(spark, sf_dir, "pages").select("page_id", "url"), 20, 7, "page_id")


@query("O6_first_non_empty", "SELECT 'x' AS v")
def o6(spark, sf_dir):
    return lists.first_non_empty(t(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 3, "x").otherwise("").alias("v")), "v")


# Intervals: spans of up to so many days.

_WIDE = {"month": 97, "day": 31, "hour": 3}
_HARVESTS = "h AS (SELECT c_custkey AS k, TIMESTAMP '2020-01-31 10:30:00' + INTERVAL 1 DAY * CAST(c_custkey % 40 AS INTEGER) AS b, TIMESTAMP '2020-01-31 10:30:00' + INTERVAL 1 DAY * CAST(c_custkey % 40 + c_custkey % {wide} AS INTEGER) AS e FROM customer)"


def _spans(spark: SparkSession, sf_dir: str, wide: int) -> DataFrame:
    k = F.col("c_custkey")
    day = lambda n: F.timestamp_add("DAY", n.cast("int"), F.lit("2020-01-31 10:30:00").cast("timestamp"))
    return t(spark, sf_dir, "customer").select(k.alias("k"), day(k % 40).alias("begin"), day(k % 40 + k % wide).alias("end"))


def _interval_sql(unit: str, clip: bool) -> str:
    a, b = ("greatest(pt, b)", "least(pt + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND, e)") if clip else ("pt", f"pt + INTERVAL 1 {unit} - INTERVAL 1 MICROSECOND")
    return f"WITH {_HARVESTS.format(wide=_WIDE[unit])}, x AS (SELECT k, b, e, unnest(generate_series(date_trunc('{unit}', b), e, INTERVAL 1 {unit})) AS pt FROM h) SELECT k, {a} AS from_ts, {b} AS until_ts FROM x"


def _interval_query(unit: str):
    def run(spark, sf_dir):
        found = intervals.intervals(_spans(spark, sf_dir, _WIDE[unit]), unit)
        return found.select("k", F.col("from_ts").cast("timestamp_ntz").alias("from_ts"), F.col("until_ts").cast("timestamp_ntz").alias("until_ts"))

    return run


for _id, _unit in (("T1", "month"), ("T2", "day"), ("T3", "hour")):
    query(f"{_id}_{_unit}_intervals", _interval_sql(_unit, _unit == "month"))(_interval_query(_unit))


@query("T4_T5_resume", "WITH h AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '1990-01-01' ELSE strftime(CAST(d AS DATE) + 1, '%Y-%m-%d') END AS from_date, '1996-12-31' AS until_date, o_orderkey % 5 <> 0 AND d >= '1996-12-31' AS synced FROM h")
def t4(spark, sf_dir):
    last = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    harvests = t(spark, sf_dir, "orders").select("o_orderkey", last.alias("last_date"), F.lit("1990-01-01").alias("earliest"), F.lit("").alias("until"))
    return intervals.plan(harvests, F.lit("1997-01-01").cast("date")).select("o_orderkey", "from_date", "until_date", "synced")


@query("T17_event_windows", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type AS key, count(*) AS n FROM events GROUP BY ALL")
def t17(spark, sf_dir):
    from .streaming.harvest import changes

    found = changes(t(spark, sf_dir, "events").select("ts", F.col("event_type").alias("key")))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "key", "n")


# Catalog.


@query("C1_C3_catalog", "SELECT '' AS set, 'oai_dc' AS format, 'http://repo.example.org/oai' AS url, '2024-12-31' AS last_date")
def c1(spark, sf_dir):
    return pages.catalog(spark, cached(spark, sf_dir)).select("set", "format", "url", "last_date")


@query("C5_sites", f"SELECT url, {_TLD} AS tld FROM pages")
def c5(spark, sf_dir):
    return lists.sites(t(spark, sf_dir, "pages")).select("url", "tld")
