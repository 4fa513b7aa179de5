"""Exact top-k search by inner product: a kNN join over a Voronoi partition.

1. Pivots are a bounded sample of the vectors: as many as the root of their number, ``PIVOTS`` at most. Every vector
   goes to the cell of a near pivot, found in two levels: the nearest of the coarse pivots, then the nearest of the pivots
   that lie around it. Cells are cut into chunks of about ``CHUNK`` vectors, so a hot cell is many groups.
2. Each cell's summary holds its count and its radius around the pivot. Queries, grouped by their own cells,
   first search that cell; that gives each query a score its k-th result can't fall below.
3. For every other cell the summary bounds the scores in it: ``q.pivot + |q| * radius``. A query meets only
   the cells whose bound reaches its score from step 2; there, only scores that reach it are given out.
4. A query's partial lists are merged, k rows a group at most.

The cells' data stay where they are and the queries, the smaller side, are sent to the cells: a query and
a chunk meet in one task as vectors in either way, with fewer bytes moved. Queries of a group are cut into
chunks as well, so a group is never larger than a chunk by a chunk.

Scores are exact integers: products are summed in float64 while no sum can pass 2**53, as 64-bit integers while none
can pass 2**63, and as Python integers otherwise; a score that doesn't fit a long is an error, as is a component that
doesn't. Bounds are rounded up.

Cases: vectors that are null, empty or hold a null or non-finite component take no part. Only vectors of equal length
are compared; lengths that the sample misses are one cell each. Ties go to the smaller id. Repeated rows are rows: each is a
candidate, and only rows of the query's own id are left out for it; a repeated query id gives one list, of its least vector
by length and bytes. Rows with a null id take no part. With k or fewer candidates all are returned. A very long vector is one
value. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import in_batches, read, table

#: Pivots of all lengths together, at most.
PIVOTS = 4096
CHUNK = 4096
LOWEST = -(1 << 63)


def integers(vector: Column) -> Column:
    """floor(64 * x) of each component as an array of longs."""

    def one(x: Column) -> Column:
        scaled = x.cast("double") * 64
        return F.when(F.abs(scaled) < 2.0**63, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component doesn't fit a 64-bit integer")).cast("long"))

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _unpack(column: pa.Array) -> np.ndarray:
    """Vectors of one length, given as lists, as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def _pack(ints: np.ndarray) -> list[bytes]:
    """Each row as little-endian integers: of 32 bits if all of them fit, else of 64."""
    narrow = (np.abs(ints) < 1 << 31).all(axis=1)
    return [row.astype("<i4" if small else "<i8").tobytes() for row, small in zip(ints, narrow, strict=True)]


def _matrix(column, dim: int) -> np.ndarray:
    """Packed rows of one length as a matrix."""
    rows = list(column)
    if all(len(r) == 4 * dim for r in rows):
        return np.frombuffer(b"".join(rows), dtype="<i4").reshape(len(rows), dim)
    return np.array([np.frombuffer(r, dtype="<i4" if len(r) == 4 * dim else "<i8").astype(np.int64) for r in rows]).reshape(len(rows), dim)


def scores(queries: np.ndarray, data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The exact inner products as int64, where they are wanted."""
    bound = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(data.astype(np.float64)).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return queries.astype(np.int64) @ data.astype(np.int64).T
    found = queries.astype(object) @ data.astype(object).T
    found[~wanted] = LOWEST
    if found.size and (found.max() >= 1 << 63 or found.min() < LOWEST):
        raise OverflowError("a score doesn't fit a 64-bit integer")
    return found.astype(np.int64)


def best(queries: pd.DataFrame, data: pd.DataFrame, k: int, block: int = 256) -> pd.DataFrame:
    """query_id, vec_id, score: for each query its k best of data with ``floor`` or more; ties to smaller ids."""
    kinds = ("query_id", "vec_id", "score")
    if not len(queries) or not len(data):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in kinds})
    data = data.sort_values("vec_id", kind="stable")
    dim = int(queries["dim"].iloc[0])
    ids, vectors = data["vec_id"].to_numpy(), _matrix(data["vec"], dim)
    out = []
    for at in range(0, len(queries), block):
        part = queries.iloc[at : at + block]
        asked, floor = part["query_id"].to_numpy(), part["floor"].to_numpy()
        others = ids[None, :] != asked[:, None]
        found = scores(_matrix(part["vec"], dim), vectors, others)
        fit = (found >= floor[:, None]) & others
        if found.shape[1] > k:  # as many places more than k as a query has rows of its own
            place = max(0, found.shape[1] - k - int((~others).sum(1).max()))
            fit &= found >= np.partition(found, place, axis=1)[:, place, None]
        row, column = np.nonzero(fit)
        score = found[row, column]
        order = np.lexsort((column, -score, row))  # columns are in the order of ids
        row, column, score = row[order], column[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        first = nth < k
        out.append((asked[row[first]], ids[column[first]], score[first]))
    return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(kinds)})


class Pivots:
    """The pivots of each length of vectors, and the coarse ones, which lead to those around them."""

    def __init__(self, sample: list[tuple[int, list[int]]]):
        by_dim: dict[int, list] = {}
        for dim, ints in sample:
            by_dim.setdefault(dim, []).append(ints)
        self.of = {dim: np.unique(np.array(x, dtype=np.float64), axis=0) for dim, x in by_dim.items()}
        self.coarse, self.around = {}, {}
        for dim, fine in self.of.items():
            self.coarse[dim] = fine[:: max(1, round(len(fine) ** 0.5))]
            near = _nearest(fine, self.coarse[dim])
            self.around[dim] = [np.flatnonzero(near == g) for g in range(len(self.coarse[dim]))]

    def centres(self, dim: int) -> np.ndarray:
        return self.of.get(dim, np.zeros((1, dim)))

    def cells(self, dim: int, x: np.ndarray) -> np.ndarray:
        if dim not in self.of:
            return np.zeros(len(x), dtype=np.int64)
        group, out = _nearest(x, self.coarse[dim]), np.zeros(len(x), dtype=np.int64)
        for g in np.unique(group):
            own, members = np.flatnonzero(group == g), self.around[dim][g]
            out[own] = members[_nearest(x[own], self.of[dim][members])]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def _pivots(vectors: DataFrame, most: int) -> Pivots:
    """The first vectors by a hash of the id: as many as the root of their number, ``most`` at most."""
    wanted = min(most, max(1, round(vectors.count() ** 0.5)))
    return Pivots([tuple(r) for r in vectors.select(F.xxhash64("vec_id").alias("mark"), "dim", "ints").orderBy("mark", "dim", "ints").limit(wanted).select("dim", "ints").collect()])


def _assign(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """dim, cell, vec_id, vec (packed), radius (distance to the pivot), is_query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                ints = _unpack(part.column(2))
                x = ints.astype(np.float64)
                cell = pivots.cells(int(dim), x)
                radius = np.sqrt(((x - pivots.centres(int(dim))[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), dim), pa.int32()), pa.array(cell.astype(np.int32)), part.column(0), pa.array(_pack(ints), pa.binary()), pa.array(radius), part.column(3)],
                    ["dim", "cell", "vec_id", "vec", "radius", "is_query"],
                )

    return in_batches(vectors.select("vec_id", "dim", "ints", "is_query"), run, "dim int, cell int, vec_id long, vec binary, radius double, is_query boolean")


def _search(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """queries: dim, cell, chunks (of the cell), query_id, vec, floor. data: dim, cell, chunk, parts (of its queries), vec_id, vec."""
    sent = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    dealt = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["dim", "cell", "chunk", "part"]
    dealt = dealt.select(*(F.col(c).alias(f"of_{c}") for c in keys), "vec_id", F.col("vec").alias("of_vec"))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        return best(q, d.rename(columns={"of_vec": "vec"}), k)

    return sent.groupBy(*keys).cogroup(dealt.groupBy(*(f"of_{c}" for c in keys))).applyInPandas(solve, "query_id long, vec_id long, score long")


def _chunk_of(column: str, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(column), chunks).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score."""
    clean = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    clean = clean.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.size(vec_col).alias("dim"), integers(F.col(vec_col)).alias("ints"))
    centres = _pivots(clean, pivots)
    placed = table(_assign(clean, centres))
    summary = placed.groupBy("dim", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius"), F.greatest(F.lit(1), F.ceil(F.count_if("is_query") / chunk)).cast("int").alias("parts")
    )
    summary = table(summary.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")))
    sizes = summary.select("dim", "cell", "parts", "chunks")
    # A row for each cell of the lengths that have pivots: no more than there are pivots.
    cells = summary.filter(F.col("dim").isin(list(centres.of))).select("dim", "cell", "radius").collect()
    data = placed.drop("is_query", "radius").join(sizes, ["dim", "cell"]).withColumn("chunk", _chunk_of("vec_id", F.col("chunks")))
    data = data.select("dim", "cell", "chunk", "parts", "vec_id", "vec")
    queries = placed.filter("is_query").groupBy("vec_id").agg(F.min(F.struct("dim", "vec", "cell")).alias("q"))
    queries = queries.select("q.dim", "q.cell", F.col("vec_id").alias("query_id"), "q.vec")

    own = queries.join(sizes, ["dim", "cell"]).select("dim", "cell", "chunks", _chunk_of("query_id", F.col("parts")).alias("part"), "query_id", "vec", F.lit(LOWEST).cast("long").alias("floor"))
    first = table(_ranked(_search(own, data, k), k))
    floors = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    met = queries.withColumnRenamed("cell", "own").join(floors, "query_id", "left").select("dim", "own", "query_id", "vec", F.coalesce("floor", F.lit(LOWEST).cast("long")).alias("floor"))
    by_dim = {}
    for dim in centres.of:
        of = [c for c in cells if c["dim"] == dim]
        by_dim[dim] = (np.array([c["cell"] for c in of], dtype=np.int32), np.array([c["radius"] for c in of]))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in (d for d in np.unique(dims).tolist() if d in by_dim):  # other lengths have one cell
                of_dim = b.filter(pa.array(dims == dim))
                cell, radius = by_dim[dim]
                pivot = centres.centres(dim)[cell]
                for at in range(0, len(of_dim), 1024):
                    part = of_dim.slice(at, 1024)
                    q = _matrix(part.column(3).to_pylist(), dim).astype(np.float64)
                    bound = q @ pivot.T + np.sqrt((q * q).sum(1))[:, None] * radius
                    bound += 1 + 1e-9 * np.abs(bound)
                    meets = (bound >= part.column(4).to_numpy().astype(np.float64)[:, None]) & (part.column(1).to_numpy()[:, None] != cell)
                    row, col = np.nonzero(meets)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(cell[col]), *(part.column(k).take(row) for k in (2, 3, 4))], ["dim", "cell", "query_id", "vec", "floor"])

    others = in_batches(met, needed, "dim int, cell int, query_id long, vec binary, floor long").join(sizes, ["dim", "cell"])
    others = others.select("dim", "cell", "chunks", _chunk_of("query_id", F.col("parts")).alias("part"), "query_id", "vec", "floor")
    return _ranked(first.drop("rank").unionByName(_search(others, data, k)), k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. Its rows are at most k from each chunk that it met."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
