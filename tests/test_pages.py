"""Pages on disk: codecs, packed files, entities, white space, deleted records, filters, compaction."""

import gzip

import pytest
import zstandard
from pyspark.sql import functions as F

from skerry.functions import text
from skerry.operators import records
from skerry.sinks import pages as sink
from skerry.sources import pages


def record(identifier, stamp, title, status="", bare=False):
    mark = f' status="{status}"' if status else ""
    dc = f"<dc:title>{title}</dc:title>"
    body = "" if status == "deleted" else f"<metadata>{dc if bare else f'<oai_dc:dc xmlns:dc=\"x\">{dc}</oai_dc:dc>'}</metadata>"
    return f"<record><header{mark}><identifier>{identifier}</identifier><datestamp>{stamp}</datestamp></header>{body}</record>"


def page(*found):
    return f'<?xml version="1.0" encoding="UTF-8"?><OAI-PMH><ListRecords>{"".join(found)}</ListRecords></OAI-PMH>'


@pytest.fixture
def root(tmp_path):
    both = page(record("id1", "2023-01-01", "Test Title 1", bare=True), record("id2", "2023-02-01", "Test Title 2"))
    (tmp_path / "2023-01-01-00000001.xml.gz").write_bytes(gzip.compress(both.encode()))
    (tmp_path / "2023-02-01-00000001.xml.zst").write_bytes(zstandard.compress(both.encode()))
    (tmp_path / "2023-02-01-00000002.xml-tmp-1").write_text(both)
    return f"file://{tmp_path}"


def titles(found):
    return sorted(r[0] for r in found.select(F.get(records.element("title"), F.lit(0))).collect())


def test_both_codecs_and_pruning(spark, root):
    assert titles(pages.read_pages(spark, root)) == ["Test Title 1"] * 2 + ["Test Title 2"] * 2
    ranged = pages.read_pages(spark, root, "2023-01-15", "2023-03-01")
    assert [r[0] for r in ranged.select("header.identifier").collect()] == ["id2"]
    assert [r["name"] for r in pages.page_files(spark, root).orderBy("name").collect()] == ["2023-01-01-00000001.xml.gz", "2023-02-01-00000001.xml.zst"]


def test_packed_files_lose_nothing(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"2023-01-0{n + 1}-00000001.xml.gz").write_bytes(gzip.compress(page(record(f"id{n}", "2023-01-01", f"t{n}")).encode()))
    root = f"file://{tmp_path}"
    plan = sink.pack(spark, root, dry_run=True).collect()
    assert plan[0]["files"] == 4 and plan[0]["saved"] == 3 * 4096
    sink.pack(spark, root)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["2023-01-04-00000001.xml.gz"]
    assert titles(pages.read_pages(spark, root)) == ["t0", "t1", "t2", "t3"]


def test_packing_leaves_no_checksums_of_other_bytes(spark, tmp_path):
    made = spark.createDataFrame([(page(record(f"id{n}", "2023-01-01", f"t{n}")),) for n in range(4)], "xml string").repartition(4)
    sink.write_pages(made, f"file://{tmp_path}/a", "2023-01-01")
    assert len(list(tmp_path.glob("a/.*.crc"))) == len(list(tmp_path.glob("a/*.xml.gz"))) >= 3
    sink.pack(spark, f"file://{tmp_path}")
    assert len(list(tmp_path.glob("a/*.xml.gz"))) == 1 and not list(tmp_path.glob("a/.*.crc"))
    assert titles(pages.read_pages(spark, f"file://{tmp_path}")) == ["t0", "t1", "t2", "t3"]


def test_blank_values_are_not_null(spark):
    values = {"a": "", "b": " ", "c": "\n\n", "d": "\ta\n", "e": None}
    rows = spark.createDataFrame([(k, v) for k, v in values.items()], "id string, v string")
    dc = {"title": F.array("v"), "description": F.array("v", F.lit("x"), F.lit(""))}
    xml = sink.record_xml(F.col("id"), F.lit("2023-01-01"), F.array(), dc, F.when(F.col("id") == "b", "deleted"))
    bare = F.concat(F.lit('<record><header><identifier>bare</identifier></header><metadata><title lang="en"> </title><subject/></metadata></record>'))
    found = pages.decode(rows.select(xml.alias("xml")).unionByName(spark.range(1).select(bare.alias("xml"))))
    got = {r[0]: r[1:] for r in found.select("header.identifier", records.element("title"), records.element("description"), "metadata.title._lang").collect()}
    assert got == {
        "a": ([""], ["", "x", ""], None),
        "b": (None, None, None),
        "c": (["\n\n"], ["\n\n", "x", ""], None),
        "d": (["a\n"], ["a\n", "x", ""], None),
        "e": (None, ["x", ""], None),
        "bare": ([" "], None, ["en"]),
    }


def marc(identifier, inner):
    return f"<record><header><identifier>{identifier}</identifier><datestamp>2023-01-01</datestamp></header><metadata>{inner}</metadata></record>"


def test_payloads_with_records(spark, tmp_path):
    inside = {
        "a": '<record xmlns="http://www.loc.gov/MARC21/slim"><leader>x</leader></record>',
        "b": "<record><record>y</record><record/><record a='1'/></record><recordInfo>z</recordInfo>",
        "c": "<![CDATA[<record>]]><!-- </record> --><dc><title>t</title></dc>",
        "d": "<r>" + "<record>" * 4 + "</record>" * 4 + "</r>",
        "e": "<dc><title>" + "long " * 200_000 + "</title></dc>",
    }
    body = page(*(marc(k, v) + "\n" for k, v in inside.items()))
    (tmp_path / "2023-01-01-00000001.xml.gz").write_bytes(gzip.compress(body.encode()) + gzip.compress(page(marc("f", "<record>g</record>")).encode()))
    found = {r["id"]: r for r in pages.read_pages(spark, f"file://{tmp_path}").select(F.col("header.identifier").alias("id"), "metadata_xml", "corrupt").collect()}
    assert {k: r["metadata_xml"] for k, r in found.items()} == inside | {"f": "<record>g</record>"}
    assert not any(r["corrupt"] for r in found.values())


def test_elements_of_any_name(spark):
    frame = spark.createDataFrame([("<x><s><t>1<t>2</t></t></s><t/><t>3</t><tt>4</tt><t>open",), (None,), ("",)], "x string")
    assert [r[0] for r in frame.select(pages.split_elements(F.col("x"), "t")).collect()] == [["<t>1<t>2</t></t>", "<t>3</t>"], None, []]


def test_dates_are_dropped_before_parsing(spark):
    odd = "<record><header><datestamp>2023-02-01</datestamp><identifier>c</identifier></header></record>"
    bare = "<record><metadata><datestamp>1999-01-01</datestamp></metadata></record>"
    raw = spark.createDataFrame([(record("a", "2023-01-01", "t"),), (record("b", "2023-02-01T10:00:00Z", "t"),), (odd,), (bare,)], "xml string")
    assert pages.maybe_in_range(raw, "2023-01-15").count() == 3
    assert pages.maybe_in_range(raw, until="2023-02-01").count() == 3
    assert pages.maybe_in_range(raw, until="2023-02-01", whole_day=True).count() == 4
    assert pages.maybe_in_range(raw).count() == 4


def test_packing_again_does_no_harm(tmp_path):
    names = [str(tmp_path / f"{n}.xml.gz") for n in "abc"]
    for n in names:
        (tmp_path / n).write_bytes(gzip.compress(n[-8:].encode()))
    sink._concatenate(names[-1], names, "1")
    sink._concatenate(names[-1], names, "2")
    for _ in range(2):
        sink._settle(f"file:{names[-1]}", [f"file:{n}" for n in names], "3")
    assert [p.name for p in tmp_path.iterdir()] == ["c.xml.gz"]
    assert gzip.decompress((tmp_path / "c.xml.gz").read_bytes()) == b"a.xml.gzb.xml.gzc.xml.gz"


def test_robustness(spark, tmp_path):
    text = page(record("a", "2023-01-31", "x&nbsp;y"), record("b", "2023-01-31T10:00:00Z", "  two  "), record("c", "2023-01-30", "", "deleted"), "<record><broken></record>")
    (tmp_path / "2023-01-31-00000001.xml.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "2023-02-01-00000001.xml.zst").write_bytes(b"")
    found = pages.read_pages(spark, f"file://{tmp_path}").cache()
    assert titles(found.filter("header.identifier in ('a', 'b')")) == ["  two  ", "x&nbsp;y"]
    assert found.filter("corrupt").count() == 1
    assert pages.in_range(found, until="2023-01-31").count() == 2
    assert pages.in_range(found, until="2023-01-31", whole_day=True).count() == 3
    infos = records.info(found.filter("not corrupt"))
    assert sorted(r[0] for r in records.live(infos).select("oai").collect()) == ["a", "b"]
    assert records.counters(infos).first().asDict() == {"total": 3, "deleted": 1, "skipped": 0, "encoded": 2}
    found.unpersist()


def test_corrupt_gzip_is_an_error(spark, tmp_path):
    (tmp_path / "2023-01-31-00000001.xml.gz").write_text("not a gzip file")
    with pytest.raises(Exception, match="(?i)gzip"):
        pages.read_pages(spark, f"file://{tmp_path}").count()


def test_streams(spark):
    assert sink.with_root([], "records") == '<records xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">\n</records>\n'
    assert sink.with_root(["a"], "") == "a\n"


def test_recompress(spark):
    body = page(record("a", "2023", "t")).encode()
    frame = spark.createDataFrame([("x.xml.gz", bytearray(gzip.compress(body))), ("y.xml.gz", bytearray(b"short")), ("z.xml.gz", bytearray(b"x" * 30))], "path string, content binary")
    got = {r["path"]: bytes(r["content"]) for r in sink.recompress(frame).collect()}
    assert zstandard.decompress(got["x.xml.zst"]) == body and got["y.xml.zst"] == got["z.xml.zst"] == b""


def test_recompress_holds_no_whole_text():
    import resource

    import pyarrow as pa

    members = [gzip.compress(b"<record>one</record>"), gzip.compress(bytes(400 << 20))]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    made = sink._as_zstd(pa.py_buffer(b"".join(members)))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10
    assert zstandard.get_frame_parameters(made).content_size == 20 + (400 << 20)
    assert zstandard.ZstdDecompressor().stream_reader(made).read(30) == b"<record>one</record>" + bytes(10)


def test_recompress_sends_workers_few_files_at_once(spark):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    files = spark.range(0, 12, 1, 1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), F.lit(3 << 20)).cast("binary").alias("content"))
    got = [r[0] for r in sink.one_by_one(files, run, "n long").collect()]
    assert sum(got) == 12 and max(got) <= 4


def test_ingest(spark):
    schema = "oai string, urls array<string>, formats array<string>, doi array<string>, types array<string>"
    rows = [
        ("oai:X:1", ["HTTP://A.org", "https://doi.org/10.1"], None, [" 10.1/A "], ["a", "info:eu-repo/semantics/draftVersion", "info:eu-repo/semantics/publishedVersion"]),
        ("OAI:x:2", ["http://b.org/"], None, None, None),
        ("oai:x:3", ["http://b.org/"], ["text/html"], None, None),
        ("oai:repec:4", ["http://b.org/"], ["application/PDF"], None, None),
        ("oai:x:5", ["http://b.org:80/q?x=1"], ["application/PDF"], ["doi"], []),
        ("oai:x:6", None, None, None, None),
    ]
    got = [(r["base_url"], r["ext_ids"]["doi"], r["link_source_id"], r["release_stage"]) for r in records.ingest_requests(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([("http://a.org/", "10.1/a", "oai:x:1", "published"), ("http://b.org/q?x=1", None, "oai:x:5", None)], key=str)


def test_json_and_purge(spark, root, tmp_path):
    import json

    lines = [json.loads(r[0]) for r in sink.json_lines(pages.read_pages(spark, root)).collect()]
    assert {x["header"]["identifier"] for x in lines} == {"id1", "id2"}
    assert {json.dumps(x["metadata"]) for x in lines} == {'{"title":"Test Title 1"}'.replace(":", ": "), '{"dc": {"title": "Test Title 2"}}'}
    from skerry.functions.text import xml_to_json

    frame = spark.createDataFrame([("",), (None,), ('<a:x b="1">t<y/><y>z</y></a:x>',), ("<open>",)], "x string")
    assert [r[0] and json.loads(r[0]) for r in frame.select(xml_to_json("x")).collect()] == [{}, {}, {"x": {"-b": "1", "y": ["", "z"], "#text": "t"}}, None]
    assert sink.purge(spark, root) and not tmp_path.exists()


def test_declared_charsets(spark):
    page = lambda charset: f'<?xml version="1.0" encoding="{charset}"?><t>Привет</t>'
    bodies = [page("windows-1251").encode("windows-1251"), page("UTF-16").encode("utf-16"), page("utf-8").encode(), page("no-such").encode(), page("us-ascii").encode(), b"\xff plain", None]
    bodies.append('<?xml version="1.0" encoding="UTF-8"?><t>é</t>'.encode("latin-1"))
    got = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b binary").orderBy("i").select(text.decode_with_fallback("b")).collect()]
    assert all("Привет" in x for x in got[:4]) and got[4] is not None and got[5] is None and got[6] is None and "é" in got[7]


def test_latest_is_decided_on_ties(spark):
    rows = spark.createDataFrame([("a", "2020", "x", {"k": "v"}), ("a", "2020", "z", None), ("a", "2019", "zz", None)], "oai string, datestamp string, title string, m map<string,string>")
    assert [r["title"] for r in records.latest(rows).collect()] == ["z"]
