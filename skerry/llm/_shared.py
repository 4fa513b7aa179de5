"""What several operators of this subpackage share: shared-folder tables and small Column helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written by ``table`` in this session, for ``clear``.
_written: list[str] = []
#: What ``kept`` holds in this session, for ``clear``.
_kept: list[DataFrame] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, whose tasks all run here, may do without: it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skerry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of a file of a narrow table, about.
FILE_ROWS = 250_000


def table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage and fixes the rows.

    Any executor can read the files, so a lost executor costs only its running tasks. rows: about how many narrow rows
    there are at most, if that is known; the number of files then follows from it, not from the number of shuffle partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_folder(spark)}/skerry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df``, kept on the executors' disks for several uses. What a lost executor held is computed again from the lineage, so
    shuffle files under it stay as long: large shuffled frames are a ``table`` instead."""
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def clear(spark: SparkSession) -> None:
    """Delete what ``table`` wrote and ``kept`` holds; call it once the results that read them are stored."""
    while _kept:
        _kept.pop().unpersist()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once, also inside lambdas, where the optimizer would repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes that a Python worker is sent at once, about; a longer row comes alone.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches bounded by bytes, as a number of rows bounds nothing where texts are long.

    The bound is set in the session, if the session has none. A worker gives back its free memory behind each partition.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(bound, None) is None:
        df.sparkSession.conf.set(bound, str(BATCH_BYTES))

    def lean(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(lean, schema)


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def keyed(id_: Column, name: str = "_key") -> list[Column]:
    """An id of any type as two columns that plain equality compares, null included: one partitioning then serves joins and windows."""
    return [F.coalesce(id_.cast("string"), F.lit("")).alias(name), id_.isNull().alias(f"{name}_null")]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text: Column, rows: int | None = None) -> DataFrame:
    """The rows of docs that ``kept`` (id, sha of ``text``, rows with both) names, one where several rows have both.

    Texts are moved once, by id and digest, and are neither sorted in a window nor gathered by group; only rows that
    repeat id and text are merged, on the map side first.
    """
    by = ["_key", "_key_null", "_sha"]
    kept = table(kept.select(*keyed(F.col("id")), F.col("sha").alias("_sha"), F.col("rows").alias("_rows")), rows)
    marked = docs.select("*", *keyed(F.col(id_col)), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_sha"))
    found = marked.join(kept.filter("_rows = 1"), by, "left_semi").select(*docs.columns)
    again = kept.filter("_rows > 1")
    if again.isEmpty():
        return found
    return found.unionByName(marked.join(again, by, "left_semi").dropDuplicates(by).select(*docs.columns))


#: The letters that normalisation folds.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ASCII texts take the fast path, whose result is the same."""
    text = whole(text)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
