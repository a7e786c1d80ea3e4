"""The pipeline's stages against brute force, and on nulls, empties, repeats and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from millrace.llm import simhash

STAGES = dict(corpus_pipeline.STAGES)


def test_run_is_the_stages_one_after_another(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by = {}
    for p in out:
        by.setdefault(p.doc_id, []).append(p)
    for pieces in by.values():
        assert sum(p.length for p in pieces) == pieces[0].doc_tokens
    ids = {r.doc_id for r in docs.collect()}
    assert set(by) < ids and len(by) > 0.3 * len(ids)


def test_near_dedup_stage_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in STAGES["SimHash near-dedup"](spark, docs, "").select("doc_id").collect()}
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for h in sets[i]:
            holders.setdefault(h, []).append(i)
    met = {(a, b) for x in holders.values() for k, a in enumerate(x) for b in x[k + 1 :]}
    for a, b in met:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    assert kept == {i for i in ids if root(i) == i}


@pytest.fixture(scope="module")
def hard(spark):
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(1, None, None, None, None), (None, "some words", "en", "s", 5), (2, "", "en", None, 0), (3, long, "en", "s", 1), (4, long, None, "s", 1), (4, long + " x", "de", "s", 1), (5, " \n ", "en", "s", 3), (6, "### 123", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["_id", "fp", "word", "_lang", "_lang_pred", "_score", "score", "_text", "c0", "_source", "_topic", "_kept", "_cell_source", "_cell_tokens", "_words", "_removed", "found"]
    return docs.withColumns({n: F.lit(k) for k, n in enumerate(names)})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, hard, name):
    stage = STAGES[name]
    out = stage(spark, hard, "")
    rows = out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == hard.columns
        assert {tuple(r[5:]) for r in rows} <= {tuple(range(17))}  # the user's columns are the user's
        assert rows
    assert stage(spark, hard.limit(0), "").count() == 0


def test_stage_language_takes_the_predicted_language(spark, hard):
    out = STAGES["language ID"](spark, hard, "").collect()
    assert {r.doc_id for r in out} == {None, 3, 4} and all(r.lang in ("en", "de") for r in out)


def test_entry_has_the_pipeline():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
