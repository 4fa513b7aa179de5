"""Toxicity by a linear-chain conditional random field over tokens.

* Labels. Documents are labelled, tokens aren't. Of a bounded sample (``SAMPLE`` documents of each class,
  the first by a hash, of ``CHARS`` characters together at most; whole texts) one part gives the evidence: words and word
  beginnings that stand in many more toxic documents than others. In toxic documents the tokens that show evidence are
  labelled 1, all other tokens 0, in clean documents every token. Equal texts (case aside) count once
  for each label, before the sample is drawn, so no copied text makes its words evidence.
* Field. Two states; a token's features are its letters, lower-cased, their beginnings and its length; the transitions
  are learned with the features' weights by gradient steps on the exact likelihood (forward-backward). A document is one
  chain, in training and in scoring.
* Scores. Forward-backward gives each token's marginal. A document's marginals are summed up in a few
  figures (their sum, largest, share, and how many are likely), and a logistic regression on the sample's
  other part turns these into the score, corrected for the labels' true shares. Tokens with a marginal of ``SPAN_AT`` or
  more, joined where they are adjacent, are the offending offsets (code points, ends exclusive).

With two states a message is one number, the odds of state 1. The documents of a block are sorted by length and
advance together, token by token; those that have ended drop out, so nothing is padded or cut.

Nothing but the text is an input of a score.

Cases: null or empty texts have no tokens and get the score of a document without evidence. A very long text is one
chain, in as many steps as it has tokens. With fewer than two labelled documents of a class no field is learned, and
every score is the share of label 1. Labels that are null are left out, as are labels of null ids; of repeated labels
each counts once for each different text. Of the texts of a repeated id the one with the least hash is learned from. Repeated rows give
repeated results, ties can't matter. An empty table gives an empty result. Extra columns are ignored here and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import in_batches, read, table, whole

#: The documents of each class in the sample, and the characters of its texts, at most.
SAMPLE, CHARS, SEED = 2500, 24_000_000, 11
#: Folds by CRC-32 of the id; this one is never learned from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD, SPAN_AT = 0.3, 0.5
#: Evidence: in so many and this share of the toxic documents at least, and so many times as often as in others.
LEAST_DOCS, LEAST_SHARE, LIFT = 5, 0.02, 4.0
#: Beginnings of words that are features; features need so many documents.
BEGINNINGS, FEATURE_DOCS = (3, 4, 5, 6, 7, 8), 5
#: The beginnings of a word of so many letters, up to the longest.
LONGEST = [tuple(k for k in BEGINNINGS if k <= n) for n in range(max(BEGINNINGS) + 1)]
#: Passes over the sample, and steps at least; tokens of a step, about.
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 300, 1 << 14, 0.05, 1e-3
#: Tokens that gradients stand for, so that their scale against the decay doesn't depend on the step.
TOKENS = 64
#: Tokens of a task whose unary scores are kept.
KEPT = 200_000
#: Characters of a block of texts, about.
BLOCK = 1 << 21
LETTERS = re.compile(r"[\W\d_]+")


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT


def features(token: str) -> list[str]:
    word = LETTERS.sub("", token.lower())
    if not word:
        return []
    return [f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k)]


class Field:
    """The features' weights, the transitions, and the document's logistic regression."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.bias = -4.0
        self.transition = np.zeros((2, 2))
        self.document = np.zeros(5)
        self.scale = (np.zeros(4), np.ones(4))
        self.prior: float | None = None
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def unary(self, tokens: list[str]) -> np.ndarray:
        """The score of state 1 against state 0 for each token."""
        known, get, bias = self.known, self.weight.get, self.bias
        if len(known) > KEPT:
            known.clear()
        for t in set(tokens).difference(known):
            word = t.lower() if t.isalpha() else LETTERS.sub("", t.lower())
            total = bias
            if word:  # the sum over features(t)
                total += get(f"={word}", 0.0)
                for k in LONGEST[: len(word) + 1][-1]:
                    total += get(f"^{word[:k]}", 0.0)
            known[t] = min(20.0, max(-20.0, total))
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.float64, count=len(tokens))

    def summary(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each text its figures, and its tokens' marginals."""
        tokens = [t.split() for t in texts]
        counts = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        likely = forward_backward(self.unary([x for t in tokens for x in t]), counts, self.transition)[0]
        figures = np.zeros((len(texts), 4))
        if some := np.flatnonzero(counts).tolist():
            first = (np.cumsum(counts) - counts)[some]
            total = np.add.reduceat(likely, first)
            hits = np.add.reduceat((likely >= SPAN_AT).astype(np.int64), first)
            figures[some] = np.stack([np.log1p(total), np.maximum.reduceat(likely, first), np.sqrt(total / counts[some]), np.log1p(hits)], axis=1)
        return figures, np.split(likely, np.cumsum(counts)[:-1]) if texts else []

    def scores(self, figures: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(figures), self.prior)
        z = ((figures - self.scale[0]) / self.scale[1]) @ self.document[:4] + self.document[4]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def forward_backward(unary: np.ndarray, counts: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Marginals of state 1 of all tokens, chain after chain (of ``counts`` tokens), and with ``pairs`` the expected transitions (2, 2). Exact."""
    n, ((m00, m01), (m10, m11)) = len(unary), np.exp(transition)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), dtype=np.int64)
    rank[order] = np.arange(len(counts))
    # Step by step, the longest chain first: token t of a chain stands at begin[t] + its chain's rank.
    active = len(counts) - np.searchsorted(np.sort(counts), np.arange(counts.max()), side="right")
    begin = np.cumsum(active) - active
    step = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begin[step] + np.repeat(rank, counts)
    boost = np.empty(n)
    boost[place] = np.exp(unary)
    forward, back = np.empty(n), np.ones(n)  # odds of state 1 by what stands up to a token, and behind it
    bounds = list(zip(begin.tolist(), (begin + active).tolist(), strict=True))
    a, z = bounds[0]
    now = forward[a:z] = boost[a:z]
    for a, z in bounds[1:]:
        now = now[: z - a]
        now = forward[a:z] = boost[a:z] * (m01 + m11 * now) / (m00 + m10 * now)
    for (a, _), (c, z) in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
        ahead = boost[c:z] * back[c:z]
        back[a : a + z - c] = (m10 + m11 * ahead) / (m00 + m01 * ahead)
    odds = forward * back
    expected = np.zeros((2, 2))
    if pairs and len(bounds) > 1:
        later = np.arange(bounds[1][0], n)
        earlier = later - np.repeat(active[:-1], active[1:])  # the same chain's token a step before
        r, ahead = forward[earlier], boost[later] * back[later]
        joint = np.stack([np.full(len(r), m00), m01 * ahead, m10 * r, m11 * r * ahead])
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
    return (odds / (1 + odds))[place], expected


def _evidence(texts: list[str], labels: np.ndarray) -> tuple[dict[str, int], set[str]]:
    """Features with their numbers, and those that are evidence."""
    counts = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        counts[label].update({f for t in set(text.split()) for f in features(t)})
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    least = max(LEAST_DOCS if n[1] >= 50 else 2, LEAST_SHARE * n[1])
    evidence = {f for f, c in counts[1].items() if c >= least and c / n[1] >= LIFT * (counts[0][f] + 0.5) / n[0]}
    kept = [f for f, c in sorted((counts[0] + counts[1]).items()) if c >= FEATURE_DOCS]
    return {f: i for i, f in enumerate(kept)}, evidence


def train(texts: list[str], labels: list[int], share: float | None = None, seed: int = SEED) -> Field:
    """share: of label 1 among all labelled documents; None if the sample shows it."""
    field = Field()
    if share is None:
        share = sum(labels) / max(1, len(labels))
    y = np.array(labels, dtype=np.int64)
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2:
        field.prior = float(share) if len(y) else 0.0
        return field
    r = np.random.default_rng(seed)
    for_field = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        rows = r.permutation(np.flatnonzero(y == label))
        for_field[rows[: -(-len(rows) * 3 // 5)]] = True
    number, evidence = _evidence([t for t, a in zip(texts, for_field, strict=True) if a], y[for_field])
    wide, none = 1 + len(BEGINNINGS), len(number)
    # The features of each different token, once; documents are rows of token numbers.
    of_token: dict[str, int] = {}
    documents = [np.array([of_token.setdefault(t, len(of_token)) for t in text.split()], dtype=np.int64) for text, a in zip(texts, for_field, strict=True) if a]
    x, shows = np.full((len(of_token), wide), none, dtype=np.int32), np.zeros(len(of_token), dtype=bool)
    for i, t in enumerate(of_token):
        found = features(t)
        known = [number[f] for f in found if f in number]
        x[i, : len(known)] = known
        shows[i] = any(f in evidence for f in found)
    tags = [shows[d] & (label == 1) for d, label in zip(documents, y[for_field], strict=True)]
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    weight, bias, transition = np.zeros(none + 1), np.array([field.bias]), np.zeros((2, 2))
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", weight), ("b", bias), ("t", transition))}
    step, batches = 0, max(1, -(-int(sizes.sum()) // BATCH))
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        order = r.permutation(len(documents))
        lots = np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // BATCH)) + 1)
        for rows in lots:
            step += 1
            part, tag, size = np.concatenate([documents[i] for i in rows]), np.concatenate([tags[i] for i in rows]), sizes[rows]
            if not len(part):
                continue
            scores = weight[x[part]].sum(1) + bias
            likely, expected = forward_backward(np.clip(scores, -20, 20), size, transition, True)
            wrong = likely - tag
            inside = np.ones(len(tag), dtype=bool)
            inside[(np.cumsum(size) - size)[size > 0]] = False  # has a token before it
            at = np.flatnonzero(inside)
            seen = np.bincount(2 * tag[at - 1] + tag[at], minlength=4).reshape(2, 2)
            scale = size.sum() / TOKENS
            gradient = {
                "w": np.bincount(x[part].reshape(-1), np.repeat(wrong, wide), minlength=none + 1) / scale + DECAY * weight,
                "b": np.array([wrong.sum()]) / scale,
                "t": (expected - seen) / scale,
            }
            gradient["w"][none] = 0
            for k, v in (("w", weight), ("b", bias), ("t", transition)):
                first, second = state[k]
                first += 0.1 * (gradient[k] - first)
                second += 0.001 * (gradient[k] ** 2 - second)
                v -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    field.weight = {f: float(weight[i]) for f, i in number.items() if abs(weight[i]) > 1e-4}
    field.bias, field.transition = float(bias[0]), transition
    rest = [t for t, a in zip(texts, for_field, strict=True) if not a]
    figures = np.concatenate([field.summary(b)[0] for b in blocks(rest)]) if rest else np.zeros((0, 4))
    _fit_document(field, figures, y[~for_field])
    seen = y[~for_field].mean() if len(rest) else share
    if field.prior is None and 0 < share < 1:
        field.document[4] += np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return field


def _fit_document(field: Field, figures: np.ndarray, y: np.ndarray) -> None:
    """Logistic regression by damped Newton steps on standardised figures."""
    if len(set(y.tolist())) < 2:
        field.prior = float(y.mean()) if len(y) else 0.0
        return
    field.scale = (figures.mean(0), figures.std(0) + 1e-6)
    design = np.concatenate([(figures - field.scale[0]) / field.scale[1], np.ones((len(y), 1))], axis=1)
    w, damp = np.zeros(5), np.diag([0.5] * 4 + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        w = w - np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + damp, design.T @ (p - y) + damp @ w)
    field.document = w


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in blocks of about ``BLOCK`` characters, a longer text alone."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, chars: int = CHARS) -> tuple[list[str], list[int], float]:
    """Labelled texts outside the held-out fold, at most ``most`` of each label and ``chars`` characters, the first by a hash of the id; and the share of label 1 in all.

    Texts are digested where they stand; only ids, digests and lengths are joined with the labels, and only the texts of the
    chosen ids (one each) reach the driver.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    text = whole(F.col(text_col))
    digested = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lower(text)).alias("alike"), F.char_length(text).alias("size"), F.xxhash64(text).alias("th"))
    there = digested.groupBy("id").agg(F.min(F.struct("th", "alike", "size")).alias("d")).join(usable.distinct(), "id").select("id", "label", "d.*")
    once = table(there.groupBy("label", "alike").agg(F.min(F.struct(F.xxhash64("id").alias("mark"), "id", "th", "size")).alias("d")).select("label", "d.*"))
    chosen = []
    for label in (0, 1):
        total = 0
        for row in once.filter(F.col("label") == label).orderBy("mark", "id").limit(most).collect():
            if total + row["size"] <= chars // 2:
                total += row["size"]
                chosen.append(row)
    if not chosen:
        return [], [], 0.0
    share = usable.agg(F.avg("label")).first()[0]
    kind = usable.schema["id"].dataType.simpleString()
    picked = F.broadcast(docs.sparkSession.createDataFrame([(r["id"], r["th"], r["label"]) for r in chosen], f"id {kind}, th long, label int"))  # 2 * most rows
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("th")).join(picked, ["id", "th"])
    rows = rows.groupBy("id", "label").agg(F.min("t").alias("t")).collect()  # one for each chosen row
    rows.sort(key=lambda r: (r["label"], r["id"]))
    return [r["t"] for r in rows], [r["label"] for r in rows], share


def _spans(text: str, likely: np.ndarray) -> str:
    """start:end of adjacent offending tokens, comma-joined."""
    out: list[list[int]] = []
    last = -2
    hits = set(np.flatnonzero(likely >= SPAN_AT).tolist())
    for i, m in enumerate(re.finditer(r"\S+", text)) if hits else ():
        if i in hits:
            if last == i - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = i
    return ",".join(f"{a}:{b}" for a, b in out)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted, spans: a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, spans = [], []
            for texts in blocks(b.column(1).to_pylist()):
                figures, likely = field.summary(texts)
                scores += field.scores(figures).tolist()
                spans += [_spans(t, m) for t, m in zip(texts, likely, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], ["id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = in_batches(docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("t")), run, f"id {kind}, score double, spans string")
    return found.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> DataFrame:
    return score(docs, train(*sample(docs, labels, id_col, text_col, label_col, most)), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns, in one pass over the texts."""
    field = train(*sample(docs, labels, id_col, text_col, label_col, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [x for texts in blocks(b.column(b.num_columns - 1).to_pylist()) for x in (field.scores(field.summary(texts)[0]) < THRESHOLD).tolist()]
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return in_batches(docs.select("*", whole(F.col(text_col)).alias("_text")), run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
