"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

* Targets. Every source's weight schedule is integrated over training; the integrals share ``budget`` times
  all words. A target stops at ``most`` times its source's size, and the excess is shared again by weight
  among the others until none is above.
* Which documents. Each source's documents stand in a fixed pseudo-random order (MD5 of the id). The demand
  is laid along them, pass after pass: in a pass a document covers as many words as it has. Documents that
  the demand covers are taken whole; the one where it ends is taken up to there. So a source's words add up
  to its target, rounded down, and no document is taken above ``most`` times.
* When. A source's cumulative demand at training time t is its target times the part of its weight's
  integral up to t. Each copy of a document gets the time at which the demand reaches the middle of what its pass
  takes of it, the inverse of that function, so a source that is taken twice is spread over all of training. The mix is
  range-sorted by that time.

A hot source is no hot task: words are summed by source and slice of the order (combined on the map side), the sums are
accumulated over slices, and only the rows of one slice are accumulated together. A slice is the documents whose hash has the same
first digits; the number of digits grows with the rows. Rows of equal positions, as those that aren't taken, are ranged by the order.

Cases: null text has size 0 and is never taken; a null source is a source, the last in order; sources
of size 0 take nothing. A very long text is one document of many words. Ties and repeated rows in the order are broken by
the text's hash; rows equal in both take whichever place. An empty table gives an empty mix. Extra columns are ignored by
``mix`` and kept by ``apply_mix``; there, rows that repeat id, text and source are one, taken as often as all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import kept, keyed, read, table, whole

#: Rows of a slice of all sources together, at most about.
SLICE = 4096


@dataclass(frozen=True)
class Schedule:
    """A weight that goes linearly from ``start`` to ``end`` over training; its integral is their mean."""

    start: float
    end: float

    @property
    def integral(self) -> float:
        return (self.start + self.end) / 2


#: Weights 5, 2 and 1 by integral: the heavy sources early, the light ones late.
CURRICULUM = (Schedule(6.0, 4.0), Schedule(2.0, 2.0), Schedule(0.5, 1.5))


def words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``: each stands at the start or after white space."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _by_index(index: Column, values: list[float]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


def _ranked(sources: DataFrame) -> DataFrame:
    """``at``: the place of each source by code point, null last, without one task for all of them."""
    key = F.struct(F.col("source").isNull(), "source")
    spread = table(sources.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = spread.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # as many rows as partitions
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    return spread.join(F.broadcast(before), part == F.col("part")).select("source", "source_size", "n_docs", (F.col("before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("at"))


def targets(sources: DataFrame, curriculum=CURRICULUM, budget: float = 1.5, most: int = 2) -> DataFrame:
    """sources (source, source_size, n_docs) with at, weight and target."""
    weighed = table(_ranked(sources).withColumn("weight", _by_index(F.col("at"), [s.integral for s in curriculum])))
    cap = F.col("source_size") * F.lit(most)
    words_in_all = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, capped = None, None
    while True:  # each round caps more sources, or is the last
        full = F.lit(False) if share is None else cap <= F.col("weight") * F.lit(share)
        n, held, free = weighed.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, share = n, (budget * words_in_all - held) / free
    return weighed.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(share or 0.0)))


def _time(part: Column, index: Column, curriculum) -> Column:
    """The time by which a schedule has ``part`` of its integral: the root of start*t + (end-start)*t*t/2 = part*integral."""
    start, slope = _by_index(index, [s.start for s in curriculum]), _by_index(index, [s.end - s.start for s in curriculum])
    reached = part * _by_index(index, [s.integral for s in curriculum])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * reached / (start + F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * slope * reached)))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", curriculum=CURRICULUM, budget: float = 1.5, most: int = 2) -> DataFrame:
    """id_col, source_col, size, source_size, target, taken, positions (of each copy; none if not taken), text_hash; range-sorted by the first position."""
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), order.alias("order"), F.xxhash64(whole(F.col(text_col))).alias("text_hash")
    )
    sized = kept(sized)
    digits, rows = 1, sized.count()
    while rows > SLICE * 16**digits:
        digits += 1
    slice_ = F.substring("order", 1, digits).alias("slice")
    slices = table(sized.groupBy("source", slice_).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")))
    of = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("n_docs")), curriculum, budget, most)
    before = slices.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")).drop("words", "docs")
    before = table(before.join(of, before["source"].eqNullSafe(of["source"])).select(before["source"], "slice", "before", "source_size", "at", "target"))
    keyed = sized.withColumn("slice", slice_)
    placed = keyed.join(before, keyed["source"].eqNullSafe(before["source"]) & (keyed["slice"] == before["slice"])).select(
        "id", "size", "text_hash", "order", keyed["source"], keyed["slice"], "before", "source_size", "at", "target"
    )
    within = Window.partitionBy("source", "slice").orderBy("order", "id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.sum("size").over(within)
    placed = placed.withColumn("start", end - F.col("size"))
    demand = F.floor("target")
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), demand - turn * F.col("source_size") - F.col("start"))) for turn in range(most)]
    times = [
        F.when(part > 0, _time((turn * F.col("source_size") + F.col("start") + part / 2) / F.col("target"), F.col("at"), curriculum)) for turn, part in enumerate(parts)
    ]
    placed = placed.withColumn("taken", sum(parts, F.lit(0)).cast("long")).withColumn("positions", F.filter(F.array(*times), lambda t: t.isNotNull()))
    found = placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "positions", "text_hash", "order")
    by = [F.get("positions", F.lit(0)), F.col("order")]
    return found.repartitionByRange(*by).sortWithinPartitions(*by).drop("order")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", curriculum=CURRICULUM, budget: float = 1.5, most: int = 2) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy, range-sorted by position.

    Texts stay whole: a document whose words are taken in part stands as often as comes nearest to that part, once at least.
    """
    found = kept(mix(docs, id_col, text_col, source_col, curriculum, budget, most))
    key = [*keyed(F.col(id_col), "_id"), *keyed(F.col(source_col), "_source")]
    by = ["_id", "_id_null", "_source", "_source_null", "_hash"]
    copies = F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size"))).cast("int")
    placed = found.filter("taken > 0").select(*key, F.col("text_hash").alias("_hash"), F.explode(F.slice("positions", F.lit(1), copies)).alias("_position"))
    marked = docs.select("*", *key, F.xxhash64(whole(F.col(text_col))).alias("_hash"))
    if not found.groupBy(id_col, source_col, "text_hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        marked = marked.dropDuplicates(by)
    place = ["_position", "_hash"]
    return marked.join(placed, by).repartitionByRange(*place).sortWithinPartitions(*place).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = [F.get("positions", F.lit(k)).alias(name) for k, name in enumerate(("position", "second_position"))]
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", *position)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT source, source_size, ((row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3) + 1 AS i FROM s),
w AS (SELECT source, source_size, CAST([5, 2, 1][i] AS DOUBLE) AS weight, CAST([6, 2, 0.5][i] AS DOUBLE) AS first, CAST([-2, 0, 1][i] AS DOUBLE) AS slope FROM n),
rounds(k, share, capped) AS (
  SELECT 0, 1.5 * (SELECT sum(source_size) FROM w) / (SELECT sum(weight) FROM w), -1
  UNION ALL
  SELECT k + 1,
         (1.5 * (SELECT sum(source_size) FROM w) - (SELECT coalesce(sum(2 * source_size), 0) FROM w WHERE 2 * source_size <= weight * share))
           / nullif((SELECT sum(weight) FROM w WHERE 2 * source_size > weight * share), 0),
         (SELECT count(*) FROM w WHERE 2 * source_size <= weight * share)
  FROM rounds WHERE k < 60 AND share IS NOT NULL AND capped <> (SELECT count(*) FROM w WHERE 2 * source_size <= weight * share)),
last AS (SELECT share FROM rounds WHERE share IS NOT NULL ORDER BY k DESC LIMIT 1),
t AS (SELECT source, source_size, weight, first, slope,
             CASE WHEN 2 * source_size <= weight * share THEN CAST(2 * source_size AS DOUBLE) ELSE weight * share END AS target FROM w, last),
p AS (SELECT doc_id, size, source_size, target, weight, first, slope, floor(target) AS demand,
             sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, demand - start)) AS one, greatest(0, least(size, demand - source_size - start)) AS two FROM p),
r AS (SELECT *, (start + one / 2) / target * weight AS reached, (source_size + start + two / 2) / target * weight AS again FROM q)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one > 0 THEN greatest(0, least(1, 2 * reached / (first + sqrt(greatest(0, first * first + 2 * slope * reached))))) END AS position,
       CASE WHEN two > 0 THEN greatest(0, least(1, 2 * again / (first + sqrt(greatest(0, first * first + 2 * slope * again))))) END AS second_position
FROM r
"""
