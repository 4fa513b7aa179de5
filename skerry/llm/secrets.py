"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

1. One pass over the whole texts gives the base findings by the patterns, and every token of ``TOKEN``'s
   characters that is long enough as a candidate, in pieces of ``PIECE`` characters with ``AROUND``
   characters of context on either side (a long token has many pieces; its score is their largest).
2. The pieces of all candidates train and calibrate the network. The labels are the base findings: candidates that
   overlap one are positive. Equal pieces of a label are one, with a count. A fifth of each class, by a hash, is held out first; all
   the rest is learned from. A copy of each positive with the context of a negative makes the network look at the token, not
   only at the word before it, and a copy with random letters and digits makes it look beyond one alphabet. The smaller class
   repeats, with new copies each time, until both weigh about the same. As an unlabelled secret is a negative, a negative's gradient is
   scaled by its own probability to the power ``DOUBT``: what looks like a positive isn't learned by heart as a negative.
   The pieces are dealt to tasks, about ``CHUNK`` each. In each of ``EPOCHS`` rounds every task goes once over all of its
   pieces (several times, where they give fewer than ``ENOUGH`` examples) from the same weights; their mean (moments included) begins the next round. Sums go by number, so reruns agree.
3. Scores are calibrated by logistic regression on the whole held-out fifth, of which nothing was trained on; pieces count as often as they
   occur. Logits are taken to 1/``GRID``, so the counts by label and logit that the driver gets lose nothing. Of the thresholds that
   keep ``RECALL`` of its positives, that in the middle between the best precision's bounds is taken.
4. Every candidate of the corpus is scored; those at the threshold or above that overlap no base finding
   are added as spans of kind ``model``. Base findings always stay.

Cases: null text counts as empty. A very long text is scanned whole, and a very long token is many pieces. Offsets are code
points, ends exclusive. Overlapping base findings of different kinds all stay; ties in start go by kind as listed. If a class
has fewer than ``LEAST`` different pieces, nothing is added. Repeated rows give repeated results, a null id is kept. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import in_batches, kept, read, table, whole

#: Fixed patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as runs are taken whole, the same as [0-9a-f]+ of 24 characters or more
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "model")
#: Candidates.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
PIECE, AROUND = 48, 24
LENGTH = PIECE + 2 * AROUND
ALNUM = [*string.ascii_letters, *string.digits]
#: The network and its training.
LEAST, RECALL, SEED = 5, 0.98, 7
CLASSES, EMBED, FILTERS, WIDE = 100, 12, 24, 5
EPOCHS, BATCH, RATE, DOUBT, GRID = 6, 64, 0.004, 0.5, 1024
#: Pieces of a task, examples that a round goes over at least (so often), chunks whose states are averaged together, and buckets of which every fifth is held out.
CHUNK, ENOUGH, TOGETHER, BUCKETS = 16384, 2048, 32, 1024

Span = tuple[int, int, str]


def base_findings(text: str) -> list[Span]:
    """start, end, kind; sorted by start, then kind as listed."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[Span]) -> list[dict]:
    out = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        pieces = []
        for at in range(start, end, PIECE):
            stop = min(end, at + PIECE)
            first = max(0, at - AROUND)
            pieces.append({"t": text[first : stop + AROUND], "a": at - first, "b": stop - first})
        out.append({"s": start, "e": end, "label": any(s < end and start < e for s, e, _ in base), "pieces": pieces})
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def encode(pieces: list[tuple[str, int, int]]) -> np.ndarray:
    """Character classes, twice as many to tell the token from its context; 0 is padding. The token begins at ``AROUND``."""
    out = np.zeros((len(pieces), LENGTH), dtype=np.int64)
    for row, (t, a, b) in zip(out, pieces, strict=True):
        codes = np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)
        kinds = np.where((codes >= 32) & (codes < 127), codes - 31, np.where(codes < 128, 96, 97)).astype(np.int64)
        kinds[a:b] += CLASSES
        row[AROUND - a : AROUND - a + len(kinds)] = kinds
    return out


class Network:
    """Embedding, one convolution, largest and token-mean activations, one output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (2 * CLASSES, EMBED)),
            "conv": r.normal(0, 1 / np.sqrt(WIDE * EMBED), (WIDE * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.2, 2 * FILTERS),
            "shift": np.zeros(1),
        }
        self.moments, self.step = tuple({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), 0
        self.slope, self.offset, self.threshold = 1.0, 0.0, 2.0

    def _forward(self, x: np.ndarray):
        p, n = self.p, LENGTH - WIDE + 1
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDE, axis=1)  # (rows, n, WIDE)
        cols = (p["embed"][windows] * (windows > 0)[..., None]).reshape(len(x), n, WIDE * EMBED)
        act = np.maximum(cols @ p["conv"] + p["bias"], 0)
        inside = (x[:, WIDE // 2 : WIDE // 2 + n] >= CLASSES).astype(float)
        share = inside / np.maximum(inside.sum(1, keepdims=True), 1)
        peak = act.argmax(1)
        pooled = np.concatenate([np.take_along_axis(act, peak[:, None, :], 1)[:, 0], (act * share[..., None]).sum(1)], axis=1)
        return pooled @ p["out"] + p["shift"], (windows, cols, act, share, peak, pooled)

    def logits(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + block])[0] for i in range(0, len(x), block)]) if len(x) else np.zeros(0)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Logits in steps of 1/``GRID``, within 50 either way."""
        return np.rint(np.clip(self.logits(x), -50, 50) * GRID).astype(np.int64)

    def _calibrated(self, cells: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (cells / GRID) + self.offset, -50, 50)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return self._calibrated(self.cells(x))

    def _gradients(self, x: np.ndarray, y: np.ndarray, doubt: float = 0.0) -> dict[str, np.ndarray]:
        """Of the cross-entropy; with ``doubt`` a negative counts by that power of its own probability, so one that looks like a positive isn't learned by heart."""
        z, (windows, cols, act, share, peak, pooled) = self._forward(x)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        d = (p - y) * np.where(y == 0, (1 - p) ** doubt, 1.0) / len(y)
        by_pool = d[:, None] * self.p["out"]
        d_act = by_pool[:, None, FILTERS:] * share[..., None]
        rows, filters = np.indices(peak.shape)
        d_act[rows, peak, filters] += by_pool[:, :FILTERS]
        d_act *= act > 0
        flat = d_act.reshape(-1, FILTERS)
        d_cols = (flat @ self.p["conv"].T).reshape(*windows.shape, EMBED) * (windows > 0)[..., None]
        at, by = windows.reshape(-1), d_cols.reshape(-1, EMBED)
        embed = np.stack([np.bincount(at, by[:, k], minlength=2 * CLASSES) for k in range(EMBED)], axis=1)
        return {"embed": embed, "conv": cols.reshape(-1, WIDE * EMBED).T @ flat, "bias": flat.sum(0), "out": pooled.T @ d, "shift": d.sum(keepdims=True)}

    def train(self, x: np.ndarray, y: np.ndarray, r: np.random.Generator) -> None:
        """Once over all rows."""
        first, second = self.moments
        order = r.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows, self.step = order[at : at + BATCH], self.step + 1
            for k, g in self._gradients(x[rows], y[rows], DOUBT).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**self.step)) / (np.sqrt(second[k] / (1 - 0.999**self.step)) + 1e-8)

    def state(self) -> np.ndarray:
        """Weights and moments."""
        return np.concatenate([d[k].ravel() for d in (self.p, *self.moments) for k in self.p])

    def resume(self, state: np.ndarray, step: int) -> None:
        at, self.step = 0, step
        for d in (self.p, *self.moments):
            for k, v in self.p.items():
                d[k] = state[at : at + v.size].reshape(v.shape).copy()
                at += v.size

    def calibrate(self, cells: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Logistic regression of the labels (each ``n`` times) on the logits by Newton steps (with a little damping, halved while the loss grows), then the threshold by the recall to keep."""
        z, w = cells / GRID, np.array([1.0, 0.0])
        design = np.stack([z, np.ones_like(z)], axis=1)
        loss = lambda w: (n * (np.logaddexp(0, design @ w) - y * (design @ w))).sum() + 5e-3 * ((w - [1.0, 0.0]) ** 2).sum()
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
            damp = 1e-2 * np.eye(2)
            move = np.linalg.solve((design * (n * q * (1 - q))[:, None]).T @ design + damp, design.T @ (n * (q - y)) + 1e-2 * (w - [1.0, 0.0]))
            w = w - next((m for m in (move / 2**k for k in range(30)) if loss(w - m) <= loss(w)), 0 * move)
        self.slope, self.offset = float(max(w[0], 1e-3)), float(w[1])
        scores, positive = self._calibrated(cells), y == 1
        order = np.argsort(scores[positive], kind="stable")
        upto = np.cumsum(n[positive][order])
        highest = float(scores[positive][order][np.searchsorted(upto, int((1 - recall) * int(upto[-1])), side="right")])
        below = float(scores[~positive & (scores < highest)].max(initial=0.0))
        self.threshold = min(highest, max(0.5, (below + highest) / 2))


def examples(positive: list[tuple[str, int, int]], negative: list[tuple[str, int, int]], r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Each positive as it is, in the context of a negative and with random letters and digits; each negative as it is."""
    lend = [negative[i] for i in r.integers(0, len(negative), len(positive))] if negative else []
    moved = [(u[:c] + t[a:b] + u[d:][:AROUND], c, c + b - a) for (t, a, b), (u, c, d) in zip(positive, lend, strict=False)]
    mixed = [(t[:a] + "".join(r.choice(ALNUM, b - a)) + t[b:], a, b) for t, a, b in positive]
    of_one = positive + moved + mixed
    return np.concatenate([encode(of_one), encode(negative)]), np.concatenate([np.ones(len(of_one)), np.zeros(len(negative))])


def go_over(network: Network, positive: list[tuple[str, int, int]], negative: list[tuple[str, int, int]], r: np.random.Generator) -> int:
    """A round of training over all of these pieces, several times if they are few; how many examples a time has."""
    rows = 3 * len(positive) + len(negative)
    for _ in range(max(1, ENOUGH // rows)):
        network.train(*examples(positive, negative, r), r)
    return rows


def repeats(positive: int, negative: int) -> tuple[int, int]:
    """How often each class is learned from in a round, as a positive gives three examples and a negative one."""
    return max(1, round(negative / (3 * positive))), max(1, round(3 * positive / negative))


def fit(positive: list[tuple[str, int, int]], negative: list[tuple[str, int, int]], recall: float = RECALL, seed: int = SEED) -> Network | None:
    """The network trained on labelled pieces in this process; None if a class has fewer than ``LEAST``."""
    if min(len(positive), len(negative)) < LEAST:
        return None
    r = np.random.default_rng(seed)
    held_out, learned = [], []
    for pieces in (positive, negative):  # every fifth of each class is held out, before anything is made of the rest
        order = r.permutation(len(pieces))
        held_out.append([pieces[i] for i in order[::5]])
        learned.append([pieces[i] for k, i in enumerate(order) if k % 5])
    learned = [pieces * n for pieces, n in zip(learned, repeats(*map(len, learned)), strict=True)]
    network = Network(seed)
    for _ in range(EPOCHS):
        go_over(network, *learned, r)
    y = np.repeat([1, 0], [len(h) for h in held_out])
    network.calibrate(np.concatenate([network.cells(encode(h)) for h in held_out]), y, np.ones(len(y)), recall)
    return network


def different_pieces(scanned: DataFrame) -> DataFrame:
    """t, a, b, label, n, mark, bucket: every different piece of every candidate, and how often it occurs."""
    pieces = scanned.select(F.explode("candidates").alias("c")).select("c.label", F.explode("c.pieces").alias("p"))
    counted = pieces.groupBy("p.t", "p.a", "p.b", "label").agg(F.count("*").alias("n"))
    mark = F.xxhash64("t", "a", "b")
    return counted.select("*", mark.alias("mark"), F.pmod(mark, F.lit(BUCKETS)).cast("int").alias("bucket"))


def split(pieces: DataFrame) -> tuple[DataFrame, DataFrame, list[int]] | None:
    """Learned and held-out pieces, and how many different positives and negatives are learned; None if a class has too few."""
    counts = {True: {}, False: {}}
    for label, bucket, n in pieces.groupBy("label", "bucket").agg(F.count("*")).collect():
        counts[label][bucket] = n
    if any(sum(c.values()) < LEAST or len(c) < 2 for c in counts.values()):
        return None
    held = {label: sorted(c)[::5] for label, c in counts.items()}
    is_held = F.when(F.col("label"), F.col("bucket").isin(held[True])).otherwise(F.col("bucket").isin(held[False]))
    learned = [sum(counts[label].values()) - sum(counts[label][b] for b in held[label]) for label in (True, False)]
    return pieces.filter(~is_held), pieces.filter(is_held), learned


_STATE = "chunk int, rows long, step int, state binary"


def _mean(rows: pa.Table, chunk: int) -> pa.Table:
    """One row for all: the mean of the states by rows, added in the chunks' order."""
    of = sorted(rows.to_pylist(), key=lambda d: d["chunk"])
    total = sum(d["rows"] for d in of)
    state = sum(np.frombuffer(d["state"]) * (d["rows"] / total) for d in of)
    step = max(d["step"] for d in of)
    return pa.table({"chunk": pa.array([chunk], pa.int32()), "rows": pa.array([total], pa.int64()), "step": pa.array([step], pa.int32()), "state": pa.array([state.tobytes()], pa.binary())})


def learn(learned: DataFrame, counts: list[int], seed: int = SEED) -> Network:
    """The network trained on all rows of ``learned``, in chunks that tasks go over at the same time."""
    again = repeats(*counts)
    chunks = -(-sum(c * n for c, n in zip(counts, again, strict=True)) // CHUNK)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("label"), again[0] - 1).otherwise(again[1] - 1))).alias("copy")
    dealt = learned.select("t", "a", "b", "label", "mark", copies)
    chunk = ((F.pmod(F.xxhash64("mark"), F.lit(chunks)) + F.col("copy")) % chunks).cast("int").alias("chunk")
    dealt = kept(dealt.select("*", chunk).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("mark", "t", "a", "b", "label", "copy"))
    network = Network(seed)
    for turn in range(EPOCHS):

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            positive, negative, chunk = [], [], None
            for b in batches:
                for d in b.to_pylist():
                    (positive if d["label"] else negative).append((d["t"], d["a"], d["b"]))
                    chunk = d["chunk"]
            if chunk is None:
                return
            rows = go_over(network, positive, negative, np.random.default_rng([seed, turn, chunk]))
            yield _mean(pa.table({"chunk": [chunk], "rows": [rows], "step": [network.step], "state": [network.state().tobytes()]}), chunk).to_batches()[0]

        def together(key: tuple, rows: pa.Table) -> pa.Table:
            return _mean(rows, key[0].as_py())

        states = in_batches(dealt.select("t", "a", "b", "label", "chunk"), run, _STATE)
        states = states.groupBy((F.col("chunk") / TOGETHER).cast("int").alias("part")).applyInArrow(together, _STATE)
        mean = _mean(states.toArrow(), 0).to_pylist()[0]
        network.resume(np.frombuffer(mean["state"]), mean["step"])
    return network


def calibrate(network: Network, held: DataFrame, recall: float = RECALL) -> None:
    """Calibration and threshold by all rows of ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            cells = [network.cells(encode(pieces[i : i + 2048])) for i in range(0, len(pieces), 2048)]
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), pa.array(np.concatenate(cells or [np.zeros(0, np.int64)]))], ["label", "n", "cell"])

    found = in_batches(held.select("t", "a", "b", "label", "n"), run, "label boolean, n long, cell long")
    rows = sorted(found.groupBy("label", "cell").agg(F.sum("n")).collect())
    network.calibrate(*(np.array(c) for c in ([r[1] for r in rows], [int(r[0]) for r in rows], [r[2] for r in rows])), recall)


def fit_all(scanned: DataFrame, recall: float = RECALL, seed: int = SEED) -> Network | None:
    """The network trained and calibrated on the pieces of all candidates; None if a class has fewer than ``LEAST``."""
    parts = split(table(different_pieces(scanned)))
    if parts is None:
        return None
    learned, held, counts = parts
    network = learn(learned, counts, seed)
    calibrate(network, held, recall)
    return network


_PIECES = "array<struct<t:string,a:int,b:int>>"
_SCHEMA = f"base array<struct<s:int,e:int,kind:string>>, candidates array<struct<s:int,e:int,label:boolean,pieces:{_PIECES}>>"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base, candidates: one pass over the texts."""
    kinds = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]))
    piece = pa.list_(pa.struct([("t", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
    whole_candidate = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.bool_()), ("pieces", piece)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, found = [], []
            for t in b.column(1):
                text = t.as_py()
                spans = base_findings(text)
                base.append([{"s": s, "e": e, "kind": k} for s, e, k in spans])
                found.append(candidates(text, spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kinds), pa.array(found, whole_candidate)], ["id", "base", "candidates"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("t")), run, f"id {kind}, {_SCHEMA}")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans (all, as text), n_model."""
    scanned = table(scan(docs, id_col, text_col))
    network = fit_all(scanned, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[c for c in row if not c["label"]] for row in b.column(2).to_pylist()]
            pieces = [(p["t"], p["a"], p["b"]) for row in found for c in row for p in c["pieces"]]
            scores = np.concatenate([network.scores(encode(pieces[i : i + 2048])) for i in range(0, len(pieces), 2048)]) if network and pieces else np.zeros(len(pieces))
            at, out = 0, []
            for base, row in zip(b.column(1).to_pylist(), found, strict=True):
                spans = [(s["s"], s["e"], s["kind"]) for s in base]
                n = [sum(k == kind for _, _, k in spans) for kind in KINDS[:3]]
                added = []
                for c in row:
                    best = scores[at : at + len(c["pieces"])].max()
                    at += len(c["pieces"])
                    if network and best >= network.threshold:
                        added.append((c["s"], c["e"], "model"))
                every = sorted(spans + added, key=lambda s: (s[0], KINDS.index(s[2])))
                out.append((*n, sha256(joined(spans).encode()).hexdigest(), joined(every), len(added)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = in_batches(scanned, run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
    return found.withColumnRenamed("id", id_col)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))
