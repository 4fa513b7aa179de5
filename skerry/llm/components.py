"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps the components and moves every node towards the smallest node of its neighbourhood; the
number of rounds grows with the logarithm of the longest path. Nothing is collected but two numbers a
round; the edges' number, which never grows, decides the number of files. Neighbourhood minima are combined on the map side and written before they are joined back, so the
edges of a hot node can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import table


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """edges: (a, b) with a > b, distinct, so many rows."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m")), 2 * rows)
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return table(moved.filter("a <> b").distinct(), rows)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the smallest node reachable, for every node that has an edge (self-loops don't count)."""
    edges = table(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        edges = _star(_star(edges, True, now[0]), False, now[0])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
