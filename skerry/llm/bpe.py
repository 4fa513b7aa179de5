"""Byte-level BPE by merge replay over an inverted index from token pair to word positions.

A block of texts is split by the pattern; its distinct words that weren't met before form one array of
tokens with links to the left and right neighbours. The index holds, for each adjacent pair that the
vocabulary can merge, the positions where it stands. Pairs leave a heap in rank order; a pair's merge is
applied at all its positions at once, and only the touched neighbours enter the index anew. So the lowest
rank always goes first, in each word as over all of them: the ids are those of merging each word by itself.
A word that is itself a token is that token.

Positions of one rank are merged together as arrays (``_many``), or one by one from left to right where there
are few of them or two of them overlap (``_few``). If the merged token can make a pair of a lower rank than its own,
only the first position of each word is merged, and the others wait in the heap until such pairs are done.

Vocabulary and pattern are parameters. The words met so far are kept for the next blocks of a task in two
generations of ``KEPT`` words at most: a full one becomes the old one, and of that only what is met again moves on.
So memory is bounded whatever the corpus holds, and frequent words are replayed once a task.

Cases: null text counts as empty and gives no tokens. Any bytes are encodable, so decoding gives back the
text exactly. Very long words take n log n steps. Ties can't occur: ranks differ. Repeated rows give repeated results;
a null id is kept. An empty table gives an empty result. Extra columns are ignored by ``digests`` and kept by
``encode``, which replaces a column named ``ids``.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import in_batches, read, whole

#: Words of a generation that a task keeps with their ids.
KEPT = 250_000
#: Positions of a rank from which they are merged as arrays.
MANY = 16
#: Characters of a block of texts, about.
BLOCK = 1 << 21


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """The ranks, and for each pair of tokens that makes a token, its rank: key a << shift | b."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.shift = max(16, max(self.token).bit_length())
        get, self.pairs = self.ranks.get, {}
        #: Tokens that stand in a pair of a lower rank than their own.
        self.early: set[int] = set()
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None:
                    self.pairs[a << self.shift | b] = rank
                    self.early.update(x for x in (a, b) if x > rank)
        self.byte = np.array([self.ranks[bytes((c,))] for c in range(256)])
        self.first = np.array([[self.pairs.get(int(a) << self.shift | int(b), -1) for b in self.byte] for a in self.byte])
        # The pairs once more, as a table of open addresses for arrays of keys.
        self.bits = max(8, (4 * len(self.pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)
        keys, values = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs)), np.fromiter(self.pairs.values(), dtype=np.int32, count=len(self.pairs))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for a slot the last one stays
            self.values[slots[free]] = values[free]
            rest = self.keys[slots] != keys
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def merged(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key's pair, -1 if it has none; negative keys have none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0) & (keys >= 0))
        while len(open_):
            slots = (slots[open_] + 1) & ((1 << self.bits) - 1) if len(slots) == len(keys) else (slots + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            go = ~hit & (there >= 0)
            open_, slots = open_[go], slots[go]
        return out


class _Replay:
    """Words as one array of tokens: ids, links to both neighbours, and the positions that wait for each rank."""

    def __init__(self, parts: list[bytes], vocabulary: Vocabulary):
        self.vocabulary, self.shift, self.pairs = vocabulary, vocabulary.shift, vocabulary.pairs.get
        text = np.frombuffer(b"".join(parts), dtype=np.uint8)
        end = len(text)
        sizes = np.array([len(w) for w in parts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        some = self.starts < self.ends
        # Position ``end`` stands for what is outside a word; its id -1 makes keys that no pair has.
        self.ids, self.left, self.right = (array("q", bytes(8 * (end + 1))) for _ in range(3))
        self.of_ids, self.to_left, self.to_right = (np.frombuffer(x, dtype=np.int64) for x in (self.ids, self.left, self.right))
        self.of_ids[:end], self.of_ids[end] = vocabulary.byte[text], -1
        self.to_left[:], self.to_right[:] = np.arange(-1, end), np.arange(1, end + 2)
        self.to_left[self.starts[some]] = end
        self.to_right[self.ends[some] - 1] = end
        self.mark = np.zeros(end + 1, dtype=bool)
        self.word = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        rank_at = np.full(end, -1)
        if end > 1:
            rank_at[:-1] = vocabulary.first[text[:-1], text[1:]]
            rank_at[self.ends[some] - 1] = -1
        places = np.flatnonzero(rank_at >= 0)
        self.index: dict[int, list[int]] = {}
        self.waiting: list[int] = []
        self._enter(rank_at[places], places)

    def _enter(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """The places, each under its rank, into the index."""
        if not len(ranks):
            return
        both = np.sort(ranks.astype(np.int64) << 32 | places)
        both = both[np.append(True, both[1:] != both[:-1])]
        ranks, places = both >> 32, (both & 0xFFFFFFFF).tolist()
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        at = 0
        for rank, to in zip(ranks[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(places)], strict=True):
            if rank in self.index:
                self.index[rank] += places[at:to]
            else:
                self.index[rank] = places[at:to]
                heappush(self.waiting, rank)
            at = to

    def run(self) -> None:
        while self.waiting:
            rank = heappop(self.waiting)
            found = self.index.pop(rank)
            if len(found) < MANY:
                self._few(rank, sorted(found))
            else:
                self._many(rank, np.array(found, dtype=np.int64))

    def _many(self, rank: int, i: np.ndarray) -> None:
        ids, left, right, shift, merged = self.of_ids, self.to_left, self.to_right, self.shift, self.vocabulary.merged
        j = right[i]
        there = merged(ids[i] << shift | ids[j]) == rank  # else an earlier merge has taken a part of it
        i, j = i[there], j[there]
        self.mark[i] = True
        overlap = self.mark[j].any()
        self.mark[i] = False
        if overlap:
            return self._few(rank, sorted(i.tolist()))
        if rank in self.vocabulary.early:
            i.sort()
            again = np.concatenate([[False], self.word[i[1:]] == self.word[i[:-1]]]) if len(i) else np.zeros(0, dtype=bool)
            if again.any():
                if len(i) - again.sum() < MANY:
                    return self._few(rank, i.tolist())
                self.index[rank] = i[again].tolist()
                heappush(self.waiting, rank)
                i = i[~again]
            j = right[i]
        k = right[j]
        ids[i], ids[j] = rank, -1
        right[i], left[k] = k, i
        h = left[i]
        to_left, to_right = merged(ids[h] << shift | rank), merged(rank << shift | ids[k])
        a, b = to_left >= 0, to_right >= 0
        self._enter(np.concatenate([to_left[a], to_right[b]]), np.concatenate([h[a], i[b]]))

    def _few(self, rank: int, found: list[int]) -> None:
        ids, left, right, shift, pairs, index = self.ids, self.left, self.right, self.shift, self.pairs, self.index
        for at, i in enumerate(found):
            j = right[i]
            if pairs(ids[i] << shift | ids[j]) != rank:
                continue
            k = right[j]
            ids[i], ids[j], right[i], left[k] = rank, -1, k, i
            lower = False
            h = left[i]
            for a, new in ((h, pairs(ids[h] << shift | rank)), (i, pairs(rank << shift | ids[k]))):
                if new is not None:
                    if new in index:
                        index[new].append(a)
                    else:
                        index[new] = [a]
                        heappush(self.waiting, new)
                    lower |= new < rank
            if lower and at + 1 < len(found):
                if rank not in index:
                    index[rank] = []
                    heappush(self.waiting, rank)
                index[rank] += found[at + 1 :]
                break

    def result(self) -> Iterator[list[int]]:
        kept = self.of_ids[:-1] >= 0
        ids, before = self.of_ids[:-1][kept].tolist(), np.concatenate([[0], np.cumsum(kept)])
        return (ids[a:b] for a, b in zip(before[self.starts].tolist(), before[self.ends].tolist(), strict=True))


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word."""
    known = list(map(vocabulary.ranks.get, words))
    state = _Replay([w for w, rank in zip(words, known, strict=True) if rank is None], vocabulary)
    state.run()
    each = state.result()
    return [[rank] if rank is not None else next(each) for rank in known]


class Encoder:
    """Encodes blocks of texts; what it learned of words serves the next block."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.kept, self.ids, self.old = kept, {}, {}

    def entry(self, ids: list[int]):
        return ids

    def learn(self, words: set[str]) -> None:
        """Afterwards ``ids`` has all the words."""
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > self.kept:
            self.old, self.ids, new = self.ids, {}, words
        again = new.intersection(self.old)
        self.ids.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new = list(new - again)
        for w, ids in zip(new, replay([w.encode() for w in new], self.vocabulary), strict=True):
            self.ids[w] = self.entry(ids)

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all learned."""
        found = [self.split(t) for t in texts]
        self.learn(set().union(*found))
        return found


class Digester(Encoder):
    """Keeps for each word its ids as text and the bytes that the ids decode to."""

    def entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        return " ".join(map(str, ids)).encode(), b"".join(map(self.vocabulary.token.__getitem__, ids))

    def digest(self, words: list[str]) -> tuple[int, str, str]:
        if not words:
            return 0, sha256().hexdigest(), sha256().hexdigest()
        ids, decoded = zip(*map(self.ids.__getitem__, words), strict=True)
        ids = b" ".join(ids)
        return ids.count(b" ") + 1, sha256(ids).hexdigest(), sha256(b"".join(decoded)).hexdigest()


def _blocks(column: pa.Array, most: int = BLOCK) -> Iterator[list[str]]:
    """The texts in blocks of about ``most`` characters, a longer text alone."""
    block, size = [], 0
    for text in column.to_pylist():
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with column ``ids``: the token ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(path, pattern)
            done = 0
            for texts in _blocks(b.column(b.num_columns - 1)):
                ids = [[i for w in words for i in encoder.ids[w]] for words in encoder.split_all(texts)]
                yield pa.RecordBatch.from_arrays([*b.slice(done, len(texts)).columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:-1], "ids"])
                done += len(texts)

    fields = [f for f in docs.schema.fields if f.name != "ids"]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    return in_batches(docs.select(*(F.col(f"`{f.name}`") for f in fields), whole(F.col(text_col)).alias("_text")), run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with column ``decoded`` (binary): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = None
        for b in batches:
            token = token or {rank: t for t, rank in load_ranks(path).items()}
            at = b.schema.names.index(ids_col)
            out = pa.array([b"".join(map(token.__getitem__, ids)) for ids in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "decoded"])

    return in_batches(encoded, run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType(), False)]))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text in one pass. kept: words of a generation (memory against time only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Digester(path, pattern, kept)
            found = [encoder.digest(words) for texts in _blocks(b.column(1)) for words in encoder.split_all(texts)]
            counts, of_ids, of_text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n", "i", "d"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = in_batches(docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("t")), run, f"id {kind}, n long, i string, d string")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("i").alias("ids_sha256"), F.col("d").alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
