"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``shingle`` words (repeats
count), each hashed by XXH64 with seed 42; a bit is set if it is set in over half of the hashes.

Links: the 64 bits are split into 4 blocks of 16. Of two fingerprints that differ in at most 2 bits, at
least two blocks are equal, so the join runs on the 6 pairs of blocks (32 bits each), and every pair that
it finds is verified by its Hamming distance. Equal fingerprints are one class before any join. A block
pair that more than ``CAP`` different fingerprints share isn't joined, which would be quadratic; its
fingerprints are linked exactly and linearly instead: two of them differ in at most 2 bits exactly if some
value differs from each of them in at most one bit, so each is dealt to its 65 values, and whoever meets at
a value is verified and linked to the smallest there.

Similarity (``similarity`` in ``near_dedup`` and ``keep_one``): texts whose sets of shingles have that Jaccard similarity or
more are linked too. Texts with equal sets are one class. The shingles are ordered by how often a bounded
sample of the documents has them, then by hash; the order decides the cost only. Two sets of n shingles at most that
are similar enough share one of the first n - ceil(similarity * n) + 1 in that order, so classes that meet at such
a shingle are the candidates and none is missed. At each shingle the neighbours in order of size, and each with
the first, are verified before all others; what these links connect isn't compared again, so a large group of near
copies costs what its rows cost. All other pairs at a shingle are compared unless their sizes and the shingle's
places rule them out. At a shingle of more than ``CROWD`` classes no pair is made as a row: its classes are dealt into blocks of
about ``LOT`` classes and ``HASHES`` hashes, and two blocks meet twice: with the sketches of their classes, after which
those that have a pair within the bound stay, and with the whole sets of these, where similar
ones are joined as they are found and only the links that connected something
leave the task, fewer than its classes. A class is at many shingles, so its set is copied often: the shingles take turns if more
would be on disk at once than the sets of all rows (``ROUND``). What is then still open at other shingles is paired by a join.
A pair is always first held against a bound: each set's hashes are counted by their last bits (a byte for
two to four hashes), and the sum of the lesser counts can't be below what the sets share. What passes is verified by the
Jaccard similarity of the whole sets (of 64-bit hashes), which are made anew for these few texts only.

Cases: null or empty texts have fingerprint zero and link like any other; texts with fewer words than a
shingle use the whole sequence. A very long text is hashed whole, its bits are summed a part at a time. Ties: of equal
ids the text with the least hash stands for a component in ``keep_one``. Rows that repeat an id stay separate rows. A null
id never becomes a component's id unless all ids in it are null. An empty table gives an empty result. Extra columns are
ignored here and kept by ``keep_one``, which tells rows apart by id and text: rows that repeat both are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from ._shared import in_batches, keep_rows, kept, read, table, whole
from .components import components

SEED = 42
#: Most fingerprints of a block pair that are compared pair by pair; more take the linear way.
CAP = 128
BLOCKS = 4
WIDTH = 64 // BLOCKS
SKETCH = 64
PAIRS = [(i, j) for i in range(BLOCKS) for j in range(i)]
#: About so many documents show which shingles are frequent: those in so many of them, the first so many by count.
SAMPLED, OFTEN, MOST = 5000, 3, 50_000
#: Texts (digests of 32 bytes) to be verified that are broadcast, at most; more are joined by a shuffle.
BROADCAST = 200_000
#: Classes at a shingle that are paired by a join, at most; and classes and hashes of a block beyond that, about.
CROWD, LOT, HASHES = 16, 1024, 1 << 19
#: Hashes of whole sets that are shuffled at once to crowded shingles, about, for each hash of all rows' sets.
ROUND = 1
#: Rounding of products with the similarity.
_TINY = 1e-6
#: The rows of bits that are summed at a time.
_STEP = 1 << 14


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, dtype=np.uint64)
    k = min(shingle, len(words))
    joined = map(b" ".join, zip(*(words[i : len(words) - k + 1 + i] for i in range(k)), strict=True))
    n = len(words) - k + 1
    return np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), dtype=np.uint64, count=n)


def _margins(hashes: np.ndarray) -> np.ndarray:
    """For each bit, the highest first, in how many more hashes it is set than not."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i : i + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return 2 * counts - len(hashes)


def _signed(margins: np.ndarray) -> int:
    return int.from_bytes(np.packbits(margins > 0).tobytes(), "big", signed=True)


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint as a signed 64-bit number."""
    return _signed(_margins(_hashes(text, shingle)))


def probed(text: bytes, shingle: int) -> tuple[int, int, bytes]:
    """The fingerprint, the class and the least hashes (their upper halves), for ``estimate``."""
    hashes = _hashes(text, shingle)
    found = np.unique(hashes)
    return _signed(_margins(hashes)), _class(found), (found[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()


def _class(found: np.ndarray) -> int:
    """Stands for a set of shingles, as a signed 64-bit number."""
    return int.from_bytes(blake2b(found.astype("<u8").tobytes(), digest_size=8).digest(), "big", signed=True)


def _sketch(found: np.ndarray) -> bytes:
    """How many hashes have each value of their last bits, a byte each; empty if a count doesn't fit."""
    m = 1 << max(3, (len(found) // 2).bit_length() - 1)
    counts = np.bincount((found & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _at_most(a: bytes, b: bytes) -> float:
    """How many hashes two sets can share, by their sketches."""
    if not a or not b:
        return float("inf")
    x, y = sorted((np.frombuffer(v, dtype=np.uint8) for v in (a, b)), key=len)
    return float(np.minimum(x, y.reshape(-1, len(x)).sum(0, dtype=np.int64)).sum())


def _prefix(found: np.ndarray, often: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a sorted set, by count and then hash: similar sets share one of them."""
    n = len(found)
    count = np.zeros(n, dtype=np.int64)
    if len(often) and n:
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        count = np.where(often[at] == found, counts[at], 0)
    return found[np.argsort(count, kind="stable")][: n - int(np.ceil(similarity * n - _TINY)) + 1]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """id, fp for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).cast("binary").alias("t")), run, f"id {kind}, fp long")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with sha, of the text, and t, its bytes."""
    text = whole(F.col(text_col))
    return docs.withColumns({"sha": F.unhex(F.sha2(text.cast("binary"), 256)), "t": text.cast("binary")})


def _frequent(docs: DataFrame, text_col: str, shingle: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many sampled documents have, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(t.as_buffer().to_pybytes(), shingle)).view(np.int64))], ["h"])

    every = max(1, n_rows // SAMPLED)
    some = docs.select(whole(F.col(text_col)).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).distinct()
    seen = in_batches(some.select(F.col("t").cast("binary")), run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    rows = seen.orderBy(F.desc("n"), "h").limit(MOST).collect()
    often, counts = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.argsort(often)
    return often[order], counts[order]


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, n_rows: int) -> DataFrame:
    """id, sha, fp, cls, n (shingles of the set), sketch, prefix for each row."""
    often, counts = _frequent(docs, text_col, shingle, n_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                fps, cls, sizes, sketches, prefixes = [], [], [], [], []
                for t in b.column(2):
                    hashes = _hashes(t.as_buffer().to_pybytes(), shingle)
                    found = np.unique(hashes)
                    fps.append(_signed(_margins(hashes)))
                    cls.append(_class(found))
                    sizes.append(len(found))
                    sketches.append(_sketch(found))
                    prefixes.append(_prefix(found, often, counts, similarity))
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(cls, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), prefix], ["id", "sha", "fp", "cls", "n", "sketch", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = _texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text")
    return in_batches(texts.select("id", "sha", "t"), run, f"id {kind}, sha binary, fp long, cls long, n int, sketch binary, prefix array<long>")


def estimate(a: bytes, b: bytes) -> float:
    """The Jaccard similarity of two texts by their least hashes; two texts without words are equal."""
    x, y = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
    most = max(len(x), len(y))
    union = np.union1d(x, y)[: SKETCH if most == SKETCH else None]
    return 1.0 if not len(union) else float(np.isin(union, np.intersect1d(x, y)).mean())


def _both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b) with va and vb, their values (cls, v)."""
    for x in "ab":
        pairs = pairs.join(values.select(F.col("cls").alias(x), F.col("v").alias(f"v{x}")), x)
    return pairs.select("a", "b", "va", "vb")


def _wanted(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _sets(wanted: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """cls, v: the whole sets of the classes in ``wanted`` (cls), each made anew from one text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                found = [np.unique(_hashes(t.as_buffer().to_pybytes(), shingle)).view(np.int64) for t in b.column(1)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["cls", "v"])

    shas = rows.select("cls", "sha").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(F.hex("sha")).alias("sha")).select("cls", F.unhex("sha").alias("sha"))
    shas = table(shas)
    if shas.count() <= BROADCAST:
        shas = F.broadcast(shas)
    texts = _texts(docs.select(F.col(text_col).alias("_text")), "_text").select("sha", "t").join(shas, "sha").select("cls", "t")
    return table(in_batches(texts, sets, "cls long, v array<long>").dropDuplicates(["cls"]))


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have the similarity or more."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).to_pylist() for k in (2, 3))
            fits = [_at_most(p["sketch"], q["sketch"]) * (1 + similarity) >= similarity * (p["n"] + q["n"]) - _TINY for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

    sketches = rows.join(_wanted(pairs), "cls", "left_semi").groupBy("cls").agg(F.max(F.struct("n", "sketch")).alias("v"))
    left = table(in_batches(_both(pairs, sketches), possible, "a long, b long"))
    found = _sets(_wanted(left), rows, docs, text_col, shingle)
    return _both(left, found).filter(F.size(F.array_intersect("va", "vb")) * (1 + similarity) >= similarity * (F.size("va") + F.size("vb")) - _TINY).select("a", "b")


def _fits(similarity: float, a: str, b: str) -> Column:
    """Whether sets a and b can be similar if the shingle at these places (from 0) is the first that they share."""
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}at"), F.col(f"{b}n") - F.col(f"{b}at"))
    return rest >= similarity / (1 + similarity) * (F.col(f"{a}n") + F.col(f"{b}n")) - _TINY


def _joined(links: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float, n_rows: int) -> DataFrame:
    """links (a, b) of classes, and links that connect all classes that are similar enough."""
    order = Window.partitionBy("h").orderBy("n", "cls")
    places = rows.select("cls", "n", F.posexplode("prefix").alias("at", "h"))
    of = lambda f: f(F.struct("cls", "n", "at")).over(order)
    marked = places.withColumns({"l": of(F.lag), "f": of(F.first), "more": F.lead("cls").over(order)})
    shared = table(marked.filter("l is not null or more is not null").select("h", "cls", "n", "at", *(F.col(f"{x}.{c}").alias(f"{x}{c}") for x in "lf" for c in ("cls", "n", "at"))))
    near = [shared.filter((F.col(f"{x}cls") != F.col("cls")) & _fits(similarity, "", x)).select(F.least("cls", f"{x}cls").alias("a"), F.greatest("cls", f"{x}cls").alias("b")) for x in "lf"]
    first = table(near[0].unionByName(near[1]).distinct())
    links = table(links.unionByName(_verified(first, rows, docs, text_col, shingle, similarity)).distinct(), n_rows)
    left = _open(shared, links, n_rows)
    sizes = left.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("hashes"))
    sizes = table(sizes.filter(F.col("many") > CROWD), n_rows)
    links = table(links.unionByName(_crowded(left.join(sizes, "h"), rows, docs, text_col, shingle, similarity)).distinct(), n_rows)
    few = _rooted(left.join(sizes, "h", "left_anti").drop("root"), links, n_rows)
    a, b = (few.select("h", *(F.col(c).alias(f"{x}{c}") for c in ("cls", "n", "at", "root"))) for x in "ab")
    rest = a.join(b, "h").filter((F.col("acls") < F.col("bcls")) & (F.col("aroot") != F.col("broot")) & _fits(similarity, "a", "b"))
    pairs = table(rest.select(F.col("acls").alias("a"), F.col("bcls").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    return links.unionByName(_verified(pairs, rows, docs, text_col, shingle, similarity))


def _pairs(n: np.ndarray, at: np.ndarray, root: np.ndarray, block: np.ndarray, similarity: float, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For classes in order of size: each, and which of those behind it may be similar by sizes and places. Reads ``root`` anew for each."""
    ends = np.searchsorted(n, n / similarity + _TINY, side="right")
    for i in range(len(n) - 1):
        j = np.arange(i + 1, ends[i])
        need = similarity / (1 + similarity) * (n[i] + n[j]) - _TINY
        j = j[(root[j] != root[i]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need) & ((block[j] != block[i]) | (not across))]
        if len(j):
            yield i, j


def _possible(n: np.ndarray, at: np.ndarray, root: np.ndarray, block: np.ndarray, sketches: list[np.ndarray], similarity: float, across: bool) -> np.ndarray:
    """Which of a shingle's classes, in order of size, have another within the bound."""
    wide = np.array([len(x) for x in sketches])
    place, of_width = np.zeros(len(n), dtype=np.int64), {}
    for w in np.unique(wide[wide > 0]).tolist():
        own = np.flatnonzero(wide == w)
        place[own], of_width[w] = np.arange(len(own)), np.stack([sketches[i] for i in own])
    found = np.zeros(len(n), dtype=bool)
    for i, j in _pairs(n, at, root, block, similarity, across):
        for w in np.unique(wide[j]).tolist():
            these = j[wide[j] == w]
            if w and wide[i]:
                most, own = of_width[w][place[these]], sketches[i]
                if w > len(own):
                    most = most.reshape(len(these), -1, len(own)).sum(1, dtype=np.int64)
                elif w < len(own):
                    own = own.reshape(-1, w).sum(0, dtype=np.int64)
                these = these[np.minimum(most, own).sum(1, dtype=np.int64) >= similarity / (1 + similarity) * (n[i] + n[these]) - _TINY]
            found[these] = True
            found[i] |= len(these) > 0
    return found


def _linked(n: np.ndarray, at: np.ndarray, root: np.ndarray, block: np.ndarray, sets: list[np.ndarray], similarity: float, across: bool) -> Iterator[tuple[int, int]]:
    """Links that connect the similar ones of a shingle's classes, in order of size, whose components differ: fewer than classes."""
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.concatenate([[0], np.cumsum(n)])
    root = root.copy()
    mark = np.zeros(len(names), dtype=bool)
    for i, j in _pairs(n, at, root, block, similarity, across):
        own = names[begin[i] : begin[i + 1]]
        mark[own] = True
        first, last = j[0], j[-1] + 1
        shared = np.add.reduceat(mark[names[begin[first] : begin[last]]], begin[first:last] - begin[first], dtype=np.int64)[j - first]
        mark[own] = False
        for k in j[shared * (1 + similarity) >= similarity * (n[i] + n[j]) - _TINY].tolist():
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                yield i, k


def _in_lots(dealt: DataFrame, column: str, work, schema: str) -> DataFrame:
    """work(classes in order of size, values of ``column``, whether only pairs across blocks count) for all rows of each h, low and high."""

    def done(parts: list[pa.RecordBatch], across: bool) -> Iterator[pa.RecordBatch]:
        lot = pa.Table.from_batches(parts).sort_by([("n", "ascending"), ("cls", "ascending")])
        values = [np.frombuffer(x.as_buffer(), dtype=np.uint8) if column == "sketch" else x.values.to_numpy() for x in lot.column(column)]
        yield from work(lot.drop_columns([column]), values, across)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for b in batches:
            keys = [b.column(c).to_numpy() for c in ("h", "low", "high")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if at == to:
                    continue
                key = tuple(int(k[at]) for k in keys)
                if key != group and parts:
                    yield from done(parts, group[1] != group[2])
                    parts = []
                group = key
                parts.append(b.slice(at, to - at))
        if parts:
            yield from done(parts, group[1] != group[2])

    ordered = dealt.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")
    return in_batches(ordered.select("h", "low", "high", "cls", "n", "at", "root", "block", column), run, schema)


def _crowded(left: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """left: h, cls, n, at, root, many, hashes. Links (a, b) that connect all similar classes at each shingle, a block of its classes against a block at a time."""

    def arrays(lot: pa.Table) -> list[np.ndarray]:
        return [lot.column(c).to_numpy().astype(np.int64) for c in ("n", "at", "root", "block")]

    def possible(lot: pa.Table, sketches: list[np.ndarray], across: bool) -> Iterator[pa.RecordBatch]:
        yield from lot.filter(pa.array(_possible(*arrays(lot), sketches, similarity, across))).to_batches()

    def linked(lot: pa.Table, sets: list[np.ndarray], across: bool) -> Iterator[pa.RecordBatch]:
        cls = lot.column("cls").to_numpy()
        found = cls[np.array(list(_linked(*arrays(lot), sets, similarity, across)), dtype=np.int64).reshape(-1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(found.min(1, initial=np.iinfo(np.int64).max)), pa.array(found.max(1, initial=np.iinfo(np.int64).min))], ["a", "b"])

    sketches = rows.join(left.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.max("sketch").alias("sketch"))
    blocks = F.ceil(F.greatest(F.col("many") / LOT, F.col("hashes") / HASHES)).cast("int")
    dealt = left.join(sketches, "cls").withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    some = table(_in_lots(dealt, "sketch", possible, "h long, low int, high int, cls long, n int, at int, root long, block int"))
    sets = _sets(some.select("cls").distinct(), rows, docs, text_col, shingle)
    once, sent = rows.agg(F.sum("n")).first()[0], some.agg(F.sum("n")).first()[0]
    rounds = max(1, int(np.ceil((sent or 0) / (ROUND * (once or 1)))))
    found = [_in_lots(some.filter(F.pmod(F.xxhash64("h"), F.lit(rounds)) == k).join(sets, "cls"), "v", linked, "a long, b long") for k in range(rounds)]
    return found[0] if rounds == 1 else reduce(DataFrame.unionByName, (table(x.distinct()) for x in found))  # few links, in few files


def _rooted(places: DataFrame, links: DataFrame, n_rows: int) -> DataFrame:
    """places (h, cls, n, at) with root, the component of the class."""
    linked = table(components(links, "a", "b").distinct(), n_rows)
    return places.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("h", "cls", "n", "at", F.coalesce("component", "cls").alias("root"))


def _open(shared: DataFrame, links: DataFrame, n_rows: int) -> DataFrame:
    """h, cls, n, at, root: the classes at each shingle where several components meet."""
    of_class = table(_rooted(shared.select("h", "cls", "n", "at"), links, n_rows))
    meeting = of_class.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("h")
    return table(of_class.join(meeting, "h", "left_semi").distinct())


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys() -> Column:
    """The 6 pairs of blocks: which pair, and its 32 bits."""
    part = [F.shiftrightunsigned(F.col("fp"), WIDTH * i).bitwiseAND((1 << WIDTH) - 1) for i in range(BLOCKS)]
    return F.array(*(F.lit(k << 32).cast("long") + F.shiftleft(part[i], WIDTH) + part[j] for k, (i, j) in enumerate(PAIRS)))


def _links(classes: DataFrame, distance: int, cap: int) -> DataFrame:
    """(a, b): fingerprints at ``distance`` or less; enough of them to connect whoever is connected."""
    keyed = classes.select("fp", F.explode(_keys()).alias("key"))
    sizes = table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    near = table(keyed.join(sizes, "key").select("key", "fp", "n"))
    few = near.filter(F.col("n") <= cap).select("key", "fp")
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, (a["key"] == b["key"]) & (a["a"] < b["b"]) & (_distance(a["a"], b["b"]) <= distance)).select("a", "b")
    many = near.filter(F.col("n") > cap).select("fp").distinct()
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = many.select("fp", F.explode(around).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter((F.col("a") != F.col("b")) & (_distance(F.col("a"), F.col("b")) <= distance))
    return pairs.unionByName(stars)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 2, cap: int = CAP, similarity: float | None = None) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (hex), component_id (smallest id reachable)."""
    if distance > 2:
        raise ValueError("the pairs of blocks find distances up to 2")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    if similarity is not None:
        rows, n_rows = _similar(docs, id_col, text_col, shingle, distance, cap, similarity)
        roots = table(rows.groupBy("root").agg(F.min("id").alias("component_id")), n_rows)
        return rows.join(roots, "root").select(F.col("id").alias(id_col), hexed, "component_id")
    rows = table(fingerprints(docs, id_col, text_col, shingle))
    n_rows = rows.count()
    classes = table(rows.groupBy("fp").agg(F.min("id").alias("least")), n_rows)
    linked = components(_links(classes, distance, cap), "a", "b")
    placed = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    placed = table(placed, n_rows)
    roots = table(placed.groupBy("root").agg(F.min("least").alias("component_id")), n_rows)
    of_class = table(placed.join(roots, "root").select("fp", "component_id"), n_rows)
    return rows.join(of_class, "fp").select(F.col("id").alias(id_col), hexed, "component_id")


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, cap: int, similarity: float | None) -> tuple[DataFrame, int]:
    """id, sha, fp, root for each row, and their number; the root stands for the component. Without a similarity fingerprints are the classes."""
    if similarity is not None and not 0 < similarity <= 1:
        raise ValueError("the similarity is above 0 and 1 at most")
    n_rows = docs.count()
    rows = _classed(docs, id_col, text_col, shingle, similarity or 1.0, n_rows)
    rows = kept(rows if similarity else rows.withColumn("cls", F.col("fp")))
    classes = table(rows.groupBy("fp", "cls").agg(F.count(F.lit(1)).alias("rows")), n_rows)
    fps = table(classes.groupBy("fp").agg(F.min("cls").alias("least")), n_rows)
    equal = classes.join(fps, "fp").select(F.col("least").alias("a"), F.col("cls").alias("b")).filter("a <> b")
    of = lambda x: fps.select(F.col("fp").alias(x), F.col("least").alias(f"{x}cls"))
    close = _links(fps, distance, cap).join(of("a"), "a").join(of("b"), "b").select(F.col("acls").alias("a"), F.col("bcls").alias("b"))
    links = close.unionByName(equal)
    if similarity is not None:
        links = _joined(links, rows, docs, text_col, shingle, similarity, n_rows)
    linked = table(components(links, "a", "b").distinct(), n_rows)
    found = rows.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("id", "sha", "fp", F.coalesce("component", "cls").alias("root"))
    return table(found, n_rows), n_rows


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 2, similarity: float | None = 0.8) -> DataFrame:
    """The documents with one of each group, the one with the smallest id (of its texts the one with the least hash), and all their columns."""
    rows, n_rows = _similar(docs, id_col, text_col, shingle, distance, CAP, similarity)
    least = rows.groupBy("root", "id", "sha").agg(F.count(F.lit(1)).alias("rows")).groupBy("root")
    staying = least.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha", "rows")).alias("of"))
    return keep_rows(docs, staying.select("of.id", "of.sha", "of.rows"), id_col, whole(F.col(text_col)), n_rows)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), shingle=3)
