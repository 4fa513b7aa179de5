"""Exact dedup, SimHash near-dedup, repeated passages: brute force and edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
import xxhash
from oracle import compare
from pyspark.sql import functions as F

from skerry.llm import exact_dedup, registry, simhash, suffix_dedup
from skerry.llm.components import components

SCHEMA = "doc_id long, text string, source string, id string, name string, n long, h string, s long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(seed, n):
    return " ".join(WORDS[hash((seed, i)) % 10] + str((seed * 7919 + i * 104729) % 97) for i in range(n))


def frame(spark, rows):
    """Rows (id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "s", "x", "y", 1, "z", 2) for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "A"), (5, "a"), (6, "É"), (7, "é"), (8, "K"), (9, "k"), (10, prose(1, 4000)), (11, prose(1, 4000).upper()), (None, "a"), (12, prose(1, 4000) + "!")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    return out


@pytest.mark.parametrize("block,hashed", [(4096, None), (16, None), (16, lambda b: F.octet_length(b).cast("long"))])
def test_exact(spark, block, hashed):
    rows = [*EDGES, (20, "same"), (20, "same"), (20, "other"), (21, "SAME"), (None, "A"), *[(30, prose(2, 3000))] * 3]
    got = exact_dedup.exact_dedup(frame(spark, rows), block=block, **({"hashed": hashed} if hashed else {})).collect()
    assert Counter(map(tuple, got)) == expected_exact(rows)


def test_exact_keeps_columns_and_empty(spark):
    docs = frame(spark, [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (None, "c"), (None, "c"), (None, None)])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(2, "A"), (3, "b"), (None, "c"), (None, None)])
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_oracle(spark, sf):
    compare(registry.queries()["op1_exact_dedup"](spark, sf), exact_dedup.ORACLE_SQL, sf)


def fingerprint(t, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, c in counts.items() if 2 * c > len(shingles))


def expected_near(rows, k):
    fps = [fingerprint(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    smallest = lambda ids: min((x for x in ids if x is not None), default=None)
    return Counter((doc, f"{fps[i]:016x}", smallest(least[find(i)])) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("cap", [128, 2])
def test_simhash(spark, cap):
    base = prose(3, 3000).split()
    rows = [*EDGES, *((100 + i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(0, 40)), (200, "two words"), (200, "two words")]
    got = simhash.near_dedup(frame(spark, rows), shingle=3, cap=cap).collect()
    assert Counter(map(tuple, got)) == expected_near(rows, 3)


def test_simhash_query_and_stage(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.queries()["op2_simhash"](spark, sf).collect()
    assert Counter(map(tuple, got)) == expected_near(rows, 3)
    docs = frame(spark, [(1, "a b c d e"), (2, "A B  c d e"), (3, "other words stand in here")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert simhash.near_dedup(frame(spark, [])).count() == 0


def jaccard(a, b, k=5):
    sets = [{tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_are_linked(spark):
    rows, pairs = [], []
    for i in range(60):
        words = prose(1000 + i, 250).split()
        edited = list(words)
        for k in range(3):
            edited[20 + 70 * k + i % 40] = f"edit{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
        pairs.append((2 * i, 2 * i + 1))
    assert all(jaccard(rows[a][1], rows[b][1]) >= 0.8 for a, b in pairs)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(frame(spark, rows), similarity=0.8).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) >= 48
    assert all(found[b] in (a, b) and found[a] == a for a, b in pairs)
    sketch = lambda t: simhash.probed(t.encode(), 5)[2]
    assert abs(simhash.estimate(sketch(rows[0][1]), sketch(rows[1][1])) - jaccard(rows[0][1], rows[1][1])) < 0.2
    assert simhash.estimate(sketch("a b c"), sketch("a b c")) == simhash.estimate(b"", b"") == 1 and simhash.estimate(sketch("a"), b"") == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()))
    assert {got[i] for i in range(51)} == {0} and got[200] == got[101] == 100
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def expected_repeats(rows, length, keep):
    seen, first = Counter(), {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] += 1
            first.setdefault(b[p : p + length], (i, p))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if seen[s] > 1 and (keep == "none" or first[s] != (i, p)):
                gone[p : p + length] = b"\x01" * length
        spans = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(gone)))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    return out


PASSAGE = prose(9, 60)
REPEATS = [
    (1, None), (2, ""), (3, "short"), (4, "a" * 2000), (5, "ab" * 700 + "c"), (6, prose(5, 200) + PASSAGE + prose(6, 200)), (7, PASSAGE), (8, prose(7, 50) + PASSAGE[3:] + "é" * 300),
    (9, "é" * 400), (10, prose(8, 300)), (11, prose(8, 300)), (12, prose(8, 300)[:700]),
]


@pytest.mark.parametrize("keep,group", [("none", 1 << 19), ("none", 100), ("first", 1 << 19), ("first", 100)])
def test_repeats(spark, keep, group):
    got = suffix_dedup.remove_repeats(frame(spark, REPEATS), keep=keep, group=group).drop("spans").collect()
    assert Counter(map(tuple, got)) == expected_repeats(REPEATS, 400, keep)


def test_repeats_rows_and_query(spark, sf):
    twice = [(1, PASSAGE), (1, PASSAGE), (2, prose(2, 100))]
    got = sorted(r["n_removed"] for r in suffix_dedup.remove_repeats(frame(spark, twice), keep="none").collect())
    assert got == [0, len(PASSAGE), len(PASSAGE)]
    assert suffix_dedup.remove_repeats(frame(spark, []), keep="none").count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = registry.queries()["op3_suffix_dedup"](spark, sf).drop("spans").collect()
    assert Counter(map(tuple, found)) == expected_repeats(rows, 400, "none")


def test_pieces_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1500)
    rows = [(1, prose(1, 900)), (2, prose(2, 300) + prose(1, 900)[2000:3000]), (3, "xyz" * 900)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), keep="none").drop("spans").collect()
    assert Counter(map(tuple, got)) == expected_repeats(rows, 400, "none")


def components_of(rows, k, similarity):
    """Brute force: the smallest id of each row's component by distance and similarity."""
    fps, sets = [fingerprint(t, k) for _, t in rows], [shingles(t, k) for _, t in rows]
    least = {i: i for i, _ in rows}
    while True:
        before = dict(least)
        for (x, (a, _)), (y, (b, _)) in itertools.combinations(enumerate(rows), 2):
            both = len(sets[x] & sets[y])
            if (fps[x] ^ fps[y]).bit_count() <= 2 or 5 * both >= similarity * 5 * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def shingles(t, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)} - {()}


@pytest.mark.parametrize("crowd,lot", [(32, 1024), (3, 7)])
def test_all_similar_texts_are_linked(spark, monkeypatch, crowd, lot):
    """Large groups of near copies with boilerplate between them, against brute force: no pair is missed."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "LOT", lot)
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    head, rows = [word() for _ in range(60)], [(1, None), (2, ""), (3, "a b")]
    for size, length, most in ((120, 80, 8), (40, 300, 12), (40, 120, 6), *[(2, 150, 5)] * 40):
        base = head + [word() for _ in range(length)]
        for _ in range(size):
            edited = list(base)
            for at in r.sample(range(len(base)), r.randint(1, most)):
                edited[at] = word()
            rows.append((100 + len(rows), " ".join(edited)))
    want = components_of(rows, 5, 0.8)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_dedup(frame(spark, rows), similarity=0.8).collect()}
    assert got == want and 20 < len(set(want.values())) < len(rows) - 60


@pytest.mark.parametrize("similarity", [0.8, None])
def test_one_of_each_group_stays(spark, similarity):
    """Null ids and repeated ids: unrelated texts stay, whatever their ids."""
    texts = [prose(i, 60) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (4, texts[3]), (6, texts[4]), (None, texts[4]), (7, texts[5]), (7, texts[5])]
    kept = simhash.keep_one(frame(spark, rows), similarity=similarity).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter([(None, texts[0]), (None, texts[1]), (5, texts[2]), (4, texts[3]), (6, texts[4]), (7, texts[5])])


def test_the_threshold_is_exact(spark):
    """Texts of 180 shingles: 160 of 200 shared is linked, 159 of 201 isn't."""
    rows = []
    for i in range(60):
        words = [f"p{i}w{k}" for k in range(184)]
        gone = 20 + i % 2
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-gone] + [f"p{i}v{k}" for k in range(gone)]))]
    assert jaccard(rows[0][1], rows[1][1]) == 0.8 > jaccard(rows[2][1], rows[3][1])
    far = all((fingerprint(rows[2 * i][1], 5) ^ fingerprint(rows[2 * i + 1][1], 5)).bit_count() > 2 for i in range(60))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(frame(spark, rows), similarity=0.8).collect()}
    assert far and all(found[2 * i + 1] == 2 * i + i % 2 for i in range(60))


def test_crowds_of_dissimilar_texts_make_no_rows_for_their_pairs(spark, monkeypatch):
    """Texts within the sketches' bound, but hardly ever similar: the pairs that are made don't grow with the square of the group."""
    r, made, verified = random.Random(3), [], simhash._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in range(10, 190, 18):
            words[at] = f"at{at}v{r.randrange(4)}"
        rows.append((i, " ".join(words)))
    want = components_of(rows, 5, 0.8)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_dedup(frame(spark, rows), similarity=0.8).collect()}
    assert got == want and sum(made) < 8 * len(rows) and 5 < len(set(want.values()))


def test_crowded_shingles_take_turns(spark, monkeypatch):
    """The sets that crowded shingles need are shuffled in rounds, and the rounds miss no link."""
    r, rounds, in_lots = random.Random(5), [], simhash._in_lots

    def counted(dealt, column, *rest):
        rounds.append(column)
        return in_lots(dealt, column, *rest)

    monkeypatch.setattr(simhash, "_in_lots", counted)
    monkeypatch.setattr(simhash, "ROUND", 0.3)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in range(10, 190, 18):
            words[at] = f"at{at}v{r.randrange(4)}"
        rows.append((i, " ".join(words)))
    want = components_of(rows, 5, 0.8)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_dedup(frame(spark, rows), similarity=0.8).collect()}
    assert got == want and rounds.count("v") > 1 and 5 < len(set(want.values()))


def test_links_of_rounds_are_few_files(spark, monkeypatch):
    """What a round's many tasks find is written as few files; equal links are written once."""
    r, rounds, in_lots = random.Random(9), [], simhash._in_lots

    def many_tasks(dealt, column, *rest):
        rounds.append(column)
        found = in_lots(dealt, column, *rest)
        return found.repartition(8) if column == "v" else found

    monkeypatch.setattr(simhash, "ROUND", 3)
    monkeypatch.setattr(simhash, "_in_lots", many_tasks)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    docs = frame(spark, [(i, " ".join([*base[:195], f"end{i}"])) for i in range(40)])
    rows = simhash.table(simhash._classed(docs, "doc_id", "text", 5, 0.8, 40))
    left = rows.select("cls", "n", F.posexplode("prefix").alias("at", "h"), F.col("cls").alias("root"))
    sizes = left.groupBy("h").agg(F.count("*").alias("many"), F.sum("n").alias("hashes")).filter("many > 1")
    found = simhash._crowded(left.join(sizes, "h"), rows, docs, "text", 5, 0.8)
    n = rounds.count("v")
    assert n > 1 and 0 < len(found.inputFiles()) <= n and found.distinct().count() >= 39
