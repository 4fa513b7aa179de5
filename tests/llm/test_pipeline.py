"""The stages, each on its predecessor's result, against what they promise."""

import re

import corpus_pipeline
from skerry.llm import _shared, bpe, simhash


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = [], [docs]
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        kept.append(_shared.table(stage(spark, kept[-1], sf)))
    assert len(names) == 5 and all(k.columns == docs.columns for k in kept[:-1])
    clean, exact, near, mixed = ([(r["doc_id"], r["text"]) for r in k.select("doc_id", "text").collect()] for k in kept[1:5])
    assert 0 < docs.count() - len(clean) < 0.2 * docs.count()
    largest = {}
    for i, t in clean:
        largest[fold(t)] = max(i, largest.get(fold(t), -1))
    assert sorted(i for i, _ in exact) == sorted(largest.values())
    ids = {i for i, _ in near}
    assert ids <= {i for i, _ in exact}
    groups = simhash.near_dedup(kept[2], similarity=0.8).collect()
    assert ids == {r["component_id"] for r in groups}
    assert {i for i, _ in mixed} <= ids and len(mixed) > 0.5 * len(near)
    assert kept[5].count() == len(mixed)


def test_run(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    found = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens"} <= set(found.columns) and found.count() > 0


def test_tables_are_shared_and_cleared(spark):
    path = _shared.shared_folder(spark)
    kept = _shared.table(spark.range(3).toDF("x"))
    assert kept.count() == 3 and path in kept.inputFiles()[0].replace("file:///", "file:///")
    _shared.clear(spark)
    assert bpe.KEPT > 0


def test_near_copies_pin_no_shuffle(spark, sf):
    """What ``kept`` holds keeps the shuffle files under it on disk as long, so the near-copy stage holds nothing that was shuffled."""
    _shared.clear(spark)
    simhash.keep_one(spark.read.parquet(f"{sf}/documents.parquet")).count()
    plans = [k._jdf.queryExecution().executedPlan().toString() for k in _shared._kept]
    _shared.clear(spark)
    assert plans and not [p for p in plans if "Exchange" in p]
