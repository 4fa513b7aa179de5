"""Pages and record streams: XML of records, page files, compaction, recompression."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import without_control, xml_to_json

ROOT_ATTRIBUTES = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
#: Bytes that a file takes on disk at least.
FILE_COST = 4096


def escaped(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def element(name: str, value: Column) -> Column:
    """An element for a value, nothing for null; control characters go."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), escaped(without_control(value)), F.lit(f"</{name}>")), F.lit(""))


def elements(name: str, values: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: element(name, v)), "")


def record_xml(identifier: Column, datestamp: Column, sets: Column, dc: dict[str, Column], status: Column | None = None) -> Column:
    """A record with its header and Dublin Core metadata (arrays by element); a deleted one has no metadata."""
    mark = F.lit("") if status is None else F.coalesce(F.concat(F.lit(' status="'), status, F.lit('"')), F.lit(""))
    head = F.concat(F.lit("<header"), mark, F.lit(">"), element("identifier", identifier), element("datestamp", datestamp), elements("setSpec", sets), F.lit("</header>"))
    body = F.concat(
        F.lit('<metadata><oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">'),
        *(elements(f"dc:{k}", v) for k, v in dc.items()),
        F.lit("</oai_dc:dc></metadata>"),
    )
    kept = body if status is None else F.when(status == "deleted", "").otherwise(body)
    return F.concat(F.lit("<record>"), head, kept, F.lit("</record>"))


def page_xml(records: Column) -> Column:
    """A response page of record texts."""
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>'), F.array_join(records, ""), F.lit("</ListRecords></OAI-PMH>")
    )


def as_pages(records: DataFrame, per_page: int = 100) -> DataFrame:
    """page (number), xml: records (xml, key) dealt into pages of about ``per_page`` by a hash of the key."""
    n = records.count()
    page = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // per_page))))
    return records.groupBy(page.alias("page")).agg(page_xml(F.sort_array(F.collect_list("xml"))).alias("xml"))


def write_pages(pages: DataFrame, directory: str, date: str) -> None:
    """Each page as <date>-<serial>.xml.gz under ``directory``, named when complete: written aside, then renamed."""
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    aside = f"{directory}/_tmp"
    pages.select("xml").write.mode("overwrite").option("compression", "gzip").text(aside)
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(directory).getFileSystem(conf)
    parts = sorted(str(s.getPath()) for s in fs.listStatus(path(aside)) if s.getPath().getName().startswith("part-") and s.getLen())
    for serial, part in enumerate(parts):  # a name for each file, no data
        fs.rename(path(part), path(f"{directory}/{date}-{serial:08d}.xml.gz"))
    fs.delete(path(aside), True)


def record_lines(records: DataFrame, xml: str = "xml") -> DataFrame:
    """One record a line."""
    return records.select(F.regexp_replace(xml, r"\s*\n\s*", " ").alias("value"))


def json_lines(records: DataFrame) -> DataFrame:
    """One JSON object a record: header, metadata as a map by element names, about; what is missing is left out."""
    header = F.struct(F.col("header._status").alias("status"), "header.identifier", "header.datestamp", "header.setSpec")
    return records.select(F.to_json(F.struct(header.alias("header"), F.parse_json(xml_to_json(F.col("metadata_xml"))).alias("metadata"), "about")).alias("value"))


def markdown(rows: DataFrame, most: int = 100) -> str:
    """A small table as Markdown, for the edge of the system: ``most`` rows."""
    cells = [rows.columns, ["---"] * len(rows.columns), *([str(v) for v in r] for r in rows.limit(most).collect())]
    return "\n".join("| " + " | ".join(c) + " |" for c in cells)


def purge(spark: SparkSession, directory: str) -> bool:
    """Remove a harvest's pages."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_root(lines: list[str], root: str) -> str:
    """A small stream with its root element, for the edge of the system."""
    if not root:
        return "".join(f"{x}\n" for x in lines)
    return f"<{root} {ROOT_ATTRIBUTES}>\n" + "".join(f"{x}\n" for x in lines) + f"</{root}>\n"


def pack_plan(files: DataFrame, least: int = 3) -> DataFrame:
    """files (path, name, date, bytes) of directories with ``least`` files or more: target (the latest file) and order."""
    from pyspark.sql.window import Window

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    by = Window.partitionBy("directory")
    found = files.withColumn("directory", directory).withColumn("files", F.count(F.lit(1)).over(by)).filter(F.col("files") >= least)
    order = by.orderBy(F.col("date").asc_nulls_last(), "name")
    return found.withColumn("nth", F.row_number().over(order)).withColumn("target", F.last("path").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def pack_statistics(files: DataFrame, least: int = 3) -> DataFrame:
    """directory, files, bytes, packed, saved: what packing does; a file that goes saves a block."""
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    found = files.groupBy(directory.alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    packed = F.col("files") >= least
    return found.withColumn("packed", packed).withColumn("saved", F.when(packed, (F.col("files") - 1) * FILE_COST).otherwise(F.lit(0)))


def _opened(path: str):
    """File system and path on it of a Hadoop path, for tasks: local disks, HDFS and S3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path)))


def _sums(path: str) -> str:
    """Where Hadoop keeps a local file's checksums; it holds whatever takes the file's place against them."""
    directory, _, name = path.rpartition("/")
    return f"{directory}/.{name}.crc"


def _concatenate(target: str, sources: list[str], attempt: str) -> None:
    """All sources into <target>-packed, which is there as a whole or not at all."""
    system, path = _opened(target)
    aside = f"{path}-tmp-{attempt}"
    with system.open_output_stream(aside, compression=None) as out:
        for source in sources:
            with system.open_input_stream(_opened(source)[1], compression=None) as part:
                while body := part.read(1 << 22):
                    out.write(body)
    system.move(aside, f"{path}-packed")


def _settle(target: str, sources: list[str], attempt: str) -> None:
    """<target>-packed takes its place and the other sources go; a repeated call finds less to do."""
    from pyarrow import fs

    system, path = _opened(target)
    there = lambda p: system.get_file_info(p).type != fs.FileType.NotFound

    def gone(*paths: str) -> None:
        for p in paths:
            if there(p):
                system.delete_file(p)

    local = isinstance(system, fs.LocalFileSystem)
    if there(f"{path}-packed"):
        gone(*[_sums(path)] * local, path)
        system.move(f"{path}-packed", path)
    for source in sources:
        other = _opened(source)[1]
        if other != path:
            gone(other, *[_sums(other)] * local)


def _in_tasks(plan: DataFrame, action: Callable[[str, list[str], str], None]) -> None:
    """``action`` for each row (target, sources) of the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        for b in batches:
            for row in b.to_pylist():
                action(row["target"], row["sources"], attempt)
            yield b.select(["target"])

    n = plan.sparkSession.sparkContext.defaultParallelism * 4
    plan.repartition(n, "target").mapInArrow(run, "target string").write.format("noop").mode("overwrite").save()


def pack(spark: SparkSession, root: str, least: int = 3, dry_run: bool = False) -> DataFrame:
    """Byte-concatenate each directory's files into its latest one; members of gzip and frames of zstd read as one.

    Tasks stream the files of a directory each, in two steps: all packed files are written aside first, then put in
    place. A task that runs again does no harm in either step. If the application ends between the steps, nothing has
    changed but files aside; if it ends within the second, a directory may hold records twice, but loses none.
    """
    from .. import config
    from ..sources.pages import page_files

    files = page_files(spark, root)
    stats = pack_statistics(files, least)
    if dry_run:
        return stats
    kept = config.workspace(spark)  # what was planned must not change with the listing
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"])
    pack_plan(files, least).groupBy("target").agg(ordered.alias("sources")).write.parquet(f"{kept}/plan")
    stats.write.parquet(f"{kept}/stats")
    plan = spark.read.parquet(f"{kept}/plan")
    for action in (_concatenate, _settle):
        _in_tasks(plan, action)
    return spark.read.parquet(f"{kept}/stats")


#: Bytes that a Python worker is sent at once, about; a larger file comes alone.
BATCH_BYTES = 8 << 20


def one_by_one(files: DataFrame, run, schema: str) -> DataFrame:
    """``files.mapInArrow`` in batches bounded by bytes, as a number of rows bounds nothing where a row is a file. The bound is set in the session, if it has none."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if files.sparkSession.conf.get(bound, None) is None:
        files.sparkSession.conf.set(bound, str(BATCH_BYTES))
    return files.mapInArrow(run, schema)


def _as_zstd(body: pa.Buffer) -> bytes:
    """gzip to zstd a part at a time, in two passes: the frame's header has the size."""
    import gzip

    import zstandard

    def parts() -> Iterator[bytes]:
        with gzip.open(pa.BufferReader(body)) as plain:
            while part := plain.read(1 << 20):
                yield part

    size = sum(map(len, parts()))
    to = zstandard.ZstdCompressor().compressobj(size=size)
    return b"".join([*map(to.compress, parts()), to.flush()]) if size else b""


def recompress(contents: DataFrame, least: int = 20) -> DataFrame:
    """path, content of .xml.gz files -> path, content as zstd; what is too short or no gzip becomes empty. A worker holds a file's bytes, never its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                body, made = content.as_buffer(), b""
                if body is not None and len(body) >= least and body[:2].to_pybytes() == b"\x1f\x8b":
                    with suppress(OSError, EOFError):
                        made = _as_zstd(body)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([made], pa.binary())], ["path", "content"])

    renamed = contents.select(F.regexp_replace("path", r"\.gz$", ".zst").alias("path"), "content")
    return one_by_one(renamed, run, "path string, content binary")
