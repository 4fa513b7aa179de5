"""Repeated passages by suffix order: which bytes lie in a string of ``length`` bytes that also starts elsewhere.

A suffix array of the whole corpus would have a suffix for each byte. Here the starts are first dealt into groups
so that equal strings always meet in one group, and only groups with something to compare are sorted:

1. ``_runs``. Of the ``GRAM``-byte grams of each string of ``length`` bytes the one with the least hash (the
   leftmost on a tie) is its anchor; equal strings have the same anchor gram. Neighbouring starts share their anchor, so
   a document is a few runs of starts, each with its gram's hash, and a digest of all bytes that the run's
   strings cover (its context). Runs whose hash stands once in the corpus, with one anchor, are done: nothing repeats there.
2. Equal contexts (128-bit digests) are one, with a count: copies, near copies and shared passages of any
   number shrink to their different contexts, by sums that are combined on the map side.
3. ``_solve``. Each group's different contexts are concatenated in the order of the documents, and the starts
   are sorted by their suffixes (prefix doubling, to ``length`` bytes). Ties go by position, so the previous smaller
   position in suffix order with a common prefix of ``length`` is the neighbour before, and the next one for a later match the
   neighbour after: the longest previous factor at a start reaches ``length`` if its neighbour before has an
   equal string, and the same holds for the longest next factor.
4. A group of more than ``GROUP`` bytes of different contexts isn't collected: each of its strings is counted by
   a 128-bit hash of its own, which is exact up to collisions of such hashes and spreads over all tasks.

``keep="first"`` removes the bytes of later copies and keeps the first (by id, then position); ``keep="none"`` removes every copy.

Cases: null text counts as empty; an empty table gives an empty result. A very long text is hashed in overlapping pieces. Texts below ``length`` bytes have no such string. Rows that repeat an id and its
text are rows of their own, copies of each other (with ``keep="first"`` all of them count as the first); different
texts may share an id. A null id comes first. Strings never cross documents. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ._shared import in_batches, read, table, whole

LENGTH, GRAM = 400, 64
#: Bytes that are hashed at a time; positions in them take PLACE bits of a 64-bit key.
PIECE, PLACE = 1 << 20, 22
#: Starts of a run, and bytes of a group's contexts, at most.
RUN, GROUP = 1 << 15, 1 << 19
#: Bytes that are sorted together, about: groups are solved many at a time.
TOGETHER = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Roller:
    """Hashes of all strings of ``size`` bytes in a text of at most ``most`` bytes: sums of c * base**i, mod 2**64, made position-free and mixed."""

    def __init__(self, base: np.uint64, size: int, most: int):
        self.size, self.up = size, _powers(base, most + 1)
        self.down = _powers(np.uint64(pow(int(base), -1, 1 << 64)), most + 1)

    def __call__(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        if n > len(self.up) - 1:
            self.__init__(self.up[1], self.size, 2 * n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        h = (sums[self.size :] - sums[: n - self.size + 1]) * self.up[: n - self.size + 1]
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        return h


def _sliding_least(keys: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` neighbouring keys, by blocks: suffix minima of one and prefix minima of the next."""
    n = len(keys)
    blocks = -(-n // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, wide)
    prefix = np.minimum.accumulate(grid, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - wide + 1], prefix[wide - 1 : n])


def _cut(text: np.ndarray, bounds: np.ndarray, length: int, roller: Roller) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text in ``text`` (cut at ``bounds``) with a run: its number, run starts and ends (of starts), hashes, several anchors?"""
    if len(text) < length:
        return []
    grams = roller(text)
    place = np.uint64((1 << PLACE) - 1)
    least = _sliding_least((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - roller.size + 1)
    anchor = (least & place).astype(np.int64)
    out = []
    for k in range(len(bounds) - 1):
        first, n = bounds[k], bounds[k + 1] - bounds[k] - length + 1
        if n <= 0:
            continue
        own = anchor[first : first + n]
        begin = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        hashes = grams[own[begin]]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        count = np.diff(np.append(np.flatnonzero(new), len(begin)))
        begin = begin[new]
        out.append((k, begin, np.append(begin[1:], n), hashes[new], count > 1))
    return out


def _pieces(sizes: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(document, first byte, past the last byte) in lots of about PIECE bytes; long documents in overlapping pieces."""
    lot, size = [], 0
    for k, n in enumerate(sizes.tolist()):
        at = 0
        while n - at >= length:
            stop = min(n, at + PIECE)
            if lot and size + stop - at > 2 * PIECE:
                yield lot
                lot, size = [], 0
            lot.append((k, at, stop))
            size += stop - at
            if stop == n:
                break
            at = stop - length + 1
    if lot:
        yield lot


def _runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """id, th, s, e (starts s to e - 1), h, c1, c2 (digest of the context), multi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(BASE, gram, 2 * PIECE)
        for b in batches:
            data = [x.as_buffer() for x in b.column(2)]
            sizes = np.array([len(d) if d else 0 for d in data], dtype=np.int64)
            for lot in _pieces(sizes, length):
                parts = [memoryview(data[k])[at:stop] for k, at, stop in lot]
                joined = b"".join(parts)
                text = np.frombuffer(joined, dtype=np.uint8)
                bounds = np.cumsum([0, *(stop - at for _, at, stop in lot)])
                row, start, end, h, multi, digests = [], [], [], [], [], []
                for k, s, e, hashes, several in _cut(text, bounds, length, roller):
                    if (e - s).max() > RUN:
                        split = [(x, min(x + RUN, y), z, True) for p, y, z in zip(s.tolist(), e.tolist(), hashes, strict=True) for x in range(p, y, RUN)]
                        s, e, hashes, several = map(np.array, zip(*split, strict=True))
                    base = int(bounds[k])
                    digests += [xxh3_128_digest(joined[base + x : base + y + length - 1]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                    row.append(np.full(len(s), lot[k][0]))
                    start.append(s + lot[k][1])
                    end.append(e + lot[k][1])
                    h.append(hashes.astype(np.uint64))
                    multi.append(several)
                if not row:
                    continue
                at = pa.array(np.concatenate(row))
                c = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(start).astype(np.int64)), pa.array(np.concatenate(end).astype(np.int64)),
                        pa.array(np.concatenate(h).view(np.int64)), pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1])), pa.array(np.concatenate(multi)),
                    ],
                    ["id", "th", "s", "e", "h", "c1", "c2", "multi"],
                )

    kind = keyed.schema["id"].dataType.simpleString()
    return in_batches(keyed, run, f"id {kind}, th long, s long, e long, h long, c1 long, c2 long, multi boolean")


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the different ones, from 1."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    return rank


def repeats(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the string of ``length`` at each of the ascending starts also starts at an earlier one, at a later one."""
    n = len(text)
    size = 1
    while size * 2 <= min(8, length):
        size *= 2
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    word = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        word = (word << np.uint64(8)) | padded[j : j + n]
    rank = _dense(word)
    while size < length:
        step = min(size, length - size)
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:]
        rank = _dense(rank * (n + 1) + after) if size + step < length else rank * (n + 1) + after
        size += step
    own = rank[starts]
    order = np.argsort(own, kind="stable")  # the suffix order of the starts; ties by position
    equal = own[order][1:] == own[order][:-1]
    earlier, later = np.zeros(len(starts), dtype=bool), np.zeros(len(starts), dtype=bool)
    earlier[order[1:]] = equal
    later[order[:-1]] = equal
    return earlier, later


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_PARTS = "array<struct<a:long,b:long>>"
_ARROW_PARTS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _contexts(wanted: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """wanted (h, c1, c2, big, and where the context stands: id, th, s, e) with ``bytes``: each document is read once, for all that is wanted of it."""
    of = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("h", "c1", "c2", "big", "s", "e")).alias("wanted"))
    joined = keyed.join(of, keyed["id"].eqNullSafe(of["id"]) & (keyed["th"] == of["th"])).select(keyed["id"], keyed["th"], "t", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                row, fields, out = [], {k: [] for k in ("h", "c1", "c2", "big", "s", "e")}, []
                for i, (t, wants) in enumerate(zip(part.column(2), part.column(3).to_pylist(), strict=True)):
                    data = memoryview(t.as_buffer())
                    for w in wants:
                        row.append(i)
                        for k, v in fields.items():
                            v.append(w[k])
                        out.append(bytes(data[w["s"] : w["e"] + length - 1]))
                ids = pa.array(row, pa.int64())
                kinds = {"big": pa.bool_()}
                yield pa.RecordBatch.from_arrays([part.column(0).take(ids), part.column(1).take(ids), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in fields.items()), pa.array(out, pa.binary())], ["id", "th", *fields, "bytes"])

    kind = keyed.schema["id"].dataType.simpleString()
    return in_batches(joined, run, f"id {kind}, th long, h long, c1 long, c2 long, big boolean, s long, e long, bytes binary")


def _solve(contexts: DataFrame, length: int) -> DataFrame:
    """h, c1, c2, earlier, any: the starts of each context, from its first, whose string stands earlier, or anywhere else."""

    def solved(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8)
        first = np.cumsum([0, *(len(r[4]) for r in rows)])
        counts = np.array([r[3] for r in rows], dtype=np.int64)
        ends = np.cumsum(counts)
        starts = np.arange(int(ends[-1])) + np.repeat(first[:-1] - (ends - counts), counts)
        earlier, later = repeats(text, starts, length)
        cuts = ends[:-1]
        columns = [[_intervals(x) for x in np.split(flags, cuts)] for flags in (earlier, earlier | later)]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), *(pa.array([[{"a": a, "b": z} for a, z in x] for x in c], _ARROW_PARTS) for c in columns)], ["h", "c1", "c2", "earlier", "any"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, group, seen = [], 0, None, set()
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for h, c1, c2, n, data in zip(*columns, strict=True):
                if h != group:
                    group, seen = h, set()
                    if size > TOGETHER:
                        yield solved(rows)
                        rows, size = [], 0
                if (c1, c2) not in seen:  # a repeated row of documents gives its contexts again
                    seen.add((c1, c2))
                    rows.append((h, c1, c2, n, data))
                    size += len(data)
        if rows:
            yield solved(rows)

    ordered = contexts.repartition(F.col("h")).sortWithinPartitions("h", "id", "th", "s")
    return in_batches(ordered.select("h", "c1", "c2", (F.col("e") - F.col("s")).alias("n"), "bytes"), run, f"h long, c1 long, c2 long, earlier {_PARTS}, any {_PARTS}")


def _count(contexts: DataFrame, length: int) -> DataFrame:
    """The same as ``_solve``, for groups that are too large to be collected: by a hash of each string."""
    once = contexts.groupBy("h", "c1", "c2").agg(F.min_by("bytes", F.struct("id", "th", "s")).alias("bytes"), F.min(F.struct("id", "th", "s")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Roller(BASE, length, RUN + length), Roller(SECOND, length, RUN + length)
        for b in batches:
            for i in range(b.num_rows):
                text = np.frombuffer(b.column(3)[i].as_buffer(), dtype=np.uint8)
                x, y = one(text).view(np.int64), two(text).view(np.int64)
                row = pa.array(np.full(len(x), i))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in (0, 1, 2, 4)), pa.array(np.arange(len(x))), pa.array(x), pa.array(y)], ["h", "c1", "c2", "at", "i", "x", "y"])

    kind = contexts.schema["id"].dataType.simpleString()
    strings = in_batches(once.select("h", "c1", "c2", "bytes", "at"), run, f"h long, c1 long, c2 long, at struct<id:{kind},th:long,s:long>, i long, x long, y long")
    strings = table(strings.withColumn("pos", F.struct("at", "i")).drop("at"))
    seen = table(strings.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).filter("n > 1"))
    hits = strings.join(seen, ["x", "y"]).select("h", "c1", "c2", "i", (F.col("pos") != F.col("first")).alias("later"))
    points = hits.groupBy("h", "c1", "c2").agg(F.sort_array(F.collect_list(F.when(F.col("later"), F.col("i")))).alias("earlier"), F.sort_array(F.collect_list("i")).alias("any"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array([[{"a": x, "b": y} for x, y in _merged(p)] for p in b.column(k).to_pylist()], _ARROW_PARTS) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], b.schema.names)

    return in_batches(points, joined, f"h long, c1 long, c2 long, earlier {_PARTS}, any {_PARTS}")


def _merged(points: list[int]) -> list[tuple[int, int]]:
    """Neighbouring starts as intervals."""
    if not points:
        return []
    at = np.array(points)
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return list(zip(at[np.append(0, cut)].tolist(), (at[np.append(cut, len(at)) - 1] + 1).tolist(), strict=True))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: str = "first", group: int = GROUP) -> DataFrame:
    """id, th, parts: for each document with a repeated string, the starts (a to b - 1) of those that ``keep`` says are removed."""
    keyed = _keyed(docs, id_col, text_col)
    runs = _runs(keyed, length, gram)
    shared = table(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("multi")).filter("n > 1 or multi").select("h"))
    runs = table(runs.join(shared, "h", "left_semi"))
    contexts = table(runs.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("multi"), F.min(F.struct("id", "th", "s", "e")).alias("first")))
    groups = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("different"), F.max("multi").alias("any_multi"), F.sum(F.col("first.e") - F.col("first.s") + length - 1).alias("size"))
    groups = table(groups.filter("different > 1 or any_multi").select("h", (F.col("size") > group).alias("big")))
    wanted = contexts.join(groups, "h").select("h", "c1", "c2", "big", "first.id", "first.th", "first.s", "first.e")
    found = table(_contexts(wanted, keyed, length))
    answers = _solve(found.filter("not big"), length).unionByName(_count(found.filter("big"), length))
    judged = contexts.join(answers, ["h", "c1", "c2"], "left").select("h", "c1", "c2", "n", "first", "earlier", "any").filter("n > 1 or size(any) > 0")
    judged = table(judged)
    joined = runs.join(judged, ["h", "c1", "c2"])
    every = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("e") - F.col("s")).alias("b")))
    if keep == "none":
        parts = F.when(F.col("n") > 1, every).otherwise(F.col("any"))
    elif keep == "first":
        own = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.th") == F.col("th")) & (F.col("first.s") == F.col("s"))
        parts = F.when(own, F.coalesce("earlier", F.array().cast(_PARTS))).otherwise(every)
    else:
        raise ValueError("keep is 'first' or 'none'")
    placed = joined.withColumn("part", F.explode(parts)).select("id", "th", F.struct((F.col("s") + F.col("part.a")).alias("a"), (F.col("s") + F.col("part.b")).alias("b")).alias("part"))
    return placed.groupBy("id", "th").agg(F.collect_list("part").alias("parts"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(whole(F.col(text_col))).alias("th"), whole(F.col(text_col)).cast("binary").alias("t"))


def _removed(parts: list[dict] | None, length: int) -> list[list[int]]:
    """The maximal runs of removed bytes."""
    out: list[list[int]] = []
    for a, b in sorted((p["a"], p["b"] + length - 1) for p in parts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: str = "first", group: int = GROUP) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end in bytes, comma-joined): a row for each row."""
    found = repeated_passages(docs, id_col, text_col, length, gram, keep, group)
    keyed = _keyed(docs, id_col, text_col)
    joined = keyed.join(found, keyed["id"].eqNullSafe(found["id"]) & (keyed["th"] == found["th"]), "left").select(keyed["id"], "t", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, parts in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data, at, digest, cut = memoryview(t.as_buffer()), 0, sha256(), _removed(parts, length)
                for first, last in cut:
                    digest.update(data[at:first])
                    at = last
                digest.update(data[at:])
                out.append((len(data), sum(y - x for x, y in cut), len(cut), digest.hexdigest(), ",".join(f"{x}:{y}" for x, y in cut)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(joined, run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string").withColumnRenamed("id", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), keep="none")
