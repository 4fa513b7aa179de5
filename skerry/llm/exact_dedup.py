"""Exact dedup by deterministic block naming, in DataFrame operations only.

Each text is cut into blocks of ``BLOCK`` bytes. The distinct blocks are sorted and get integer names;
then adjacent names are paired, the distinct pairs are sorted and named, and so on until one name is
left for each document. Equal names of equally long texts mean equal texts, without any collision:

* Only the distinct blocks are shuffled as bytes (combined on the map side first). A 64-bit hash brings
  the names back to the documents, and every hash that stands for two different blocks is resolved by
  the bytes themselves (``_clashing``), so the hash never decides.
* The levels above work on pairs of integers; there are log2(blocks of the longest document) of them.

Cases: null text counts as empty, and empty texts are equal to each other. Every row is a document and gives a
row, also where it repeats both the id and the text of another (then all such rows are kept or none, and ``drop_copies``
keeps one of them). A null id is smaller than any other. Different texts under one id are different documents. A very
long text is only more blocks. Ties in the id can't matter: rows with equal id and text are the same. An empty table
gives an empty result. Extra columns are ignored here and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fold_ascii, keep_rows, kept, let, read, table

#: Bytes of a block.
BLOCK = 4096
#: Stands for the missing right half of a pair.
NONE = -1


def _cut(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """A row for each block: id, sha (of the whole text), n (bytes), pos, block."""
    parts = let(
        fold_ascii(F.col(text_col)).cast("binary"),
        lambda b: F.struct(
            F.unhex(F.sha2(b, 256)).alias("sha"),
            F.octet_length(b).cast("long").alias("n"),
            F.transform(
                F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length(b), F.lit(1)) - 1) / block).cast("int")),
                lambda i: F.substring(b, i * block + 1, F.lit(block)),
            ).alias("blocks"),
        ),
    )
    return docs.select(F.col(id_col).alias("id"), parts.alias("d")).select("id", "d.sha", "d.n", F.posexplode("d.blocks").alias("pos", "block"))


def _hash(block: Column) -> Column:
    return F.xxhash64(block)


def _clashing(rows: DataFrame, names: DataFrame) -> DataFrame | None:
    """Rows whose hash stands for several blocks, with names by the bytes; None if there are none."""
    clashes = names.filter("blocks > 1").select("h")
    if clashes.isEmpty():
        return None
    hit = rows.join(clashes, "h")
    by_bytes = table(hit.select("block").distinct().sortWithinPartitions("block").select("block", (-2 - F.monotonically_increasing_id()).alias("name")))
    return hit.join(by_bytes, "block").select("id", "sha", "n", "pos", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed=_hash) -> tuple[DataFrame, DataFrame, int]:
    """id, sha, n, name, rows: two documents have equal texts exactly if n and name are equal; rows have that id and text. And id, sha, n of each row, and their number."""
    rows = _cut(docs, id_col, text_col, block).withColumn("h", hashed(F.col("block")))
    blocks = rows.select("h", "block").distinct().sortWithinPartitions("block").select("h", F.monotonically_increasing_id().alias("name"))
    names = table(blocks.groupBy("h").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("blocks")))
    named = rows.select("id", "sha", "n", "pos", "h").join(names.filter("blocks = 1").select("h", "name"), "h").select("id", "sha", "n", "pos", "name")
    if (clashing := _clashing(rows, names)) is not None:
        named = named.unionByName(clashing)
    level = kept(named.withColumn("left", F.greatest(F.ceil(F.col("n") / block), F.lit(1))))
    each = level.filter("pos = 0").select("id", "sha", "n")
    longest, many, n_rows = level.agg(F.max("left"), F.count_if(F.col("left") > 1), F.count_if(F.col("pos") == 0)).first()
    longest = longest or 1
    found = each.select("*", F.lit(None).cast("long").alias("name"), F.lit(1).alias("rows")).unionByName(level.filter("left = 1").select("id", "sha", "n", "name", F.lit(0).alias("rows")))
    while longest > 1:
        pairs = (
            level.filter("left > 1")
            .groupBy("id", "sha", "n", "left", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b"))
        )
        names = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id())
        level = table(pairs.join(names, ["a", "b"]).select("id", "sha", "n", "pos", "name", F.ceil(F.col("left") / 2).alias("left")), many)
        found = found.unionByName(level.filter("left = 1").select("id", "sha", "n", "name", F.lit(0).alias("rows")))
        longest = -(-longest // 2)
    return found.groupBy("id", "sha", "n").agg(F.max("name").alias("name"), F.sum("rows").alias("rows")), each, n_rows


def _groups(docs: DataFrame, id_col: str, text_col: str, block: int = BLOCK, hashed=_hash) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """identities (written), n, name, keep_id, group_size, and the rows with their number."""
    found, each, rows = identities(docs, id_col, text_col, block, hashed)
    found = table(found, rows)
    return found, table(found.groupBy("n", "name").agg(F.max("id").alias("keep_id"), F.sum("rows").alias("group_size")), rows), each, rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed=_hash) -> DataFrame:
    """One row for each row: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the largest id stays. The groups are written before they are joined, so
    that both sides of a join are plain exchanges and a hot group's side can be split at run time.
    """
    found, groups, each, rows = _groups(docs, id_col, text_col, block, hashed)
    judged = table(found.join(groups, ["n", "name"]).select("id", "sha", "n", "keep_id", "group_size"), rows)
    same = each["id"].eqNullSafe(judged["id"]) & (each["sha"] == judged["sha"]) & (each["n"] == judged["n"])
    return each.join(judged, same).select(
        each["id"].alias(id_col), "keep_id", "group_size", each["id"].eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(each["sha"])).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text one stays."""
    found, groups, _, rows = _groups(docs, id_col, text_col)
    staying = found.join(groups, ["n", "name"]).filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "sha", "rows")
    return keep_rows(docs, staying, id_col, fold_ascii(F.col(text_col)), rows)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
