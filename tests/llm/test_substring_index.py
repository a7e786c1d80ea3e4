"""The fingerprint index: verification, rows that share an id, frequent anchors, compaction, a reopened index."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import substring

DOCS = "doc_id long, text string"


def brute(rows):
    """Kept words of (id, text hash, text) rows, in that order."""
    seen, out = {}, []
    split = [(i, c, (t or "").encode().split()) for i, c, t in rows]
    for i, c, w in split:
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            seen[key] = min(seen.get(key, (i, c, s)), (i, c, s))
    for i, c, w in split:
        gone = {p for s in range(len(w) - 19) if seen[tuple(w[s : s + 20])] < (i, c, s) for p in range(s, s + 20)}
        out.append((i, c, hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out)


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    passages = [[word() for _ in range(r.choice([20, 25, 80]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(r.randrange(0, 5)):
            w += [word() for _ in range(r.randrange(0, 30))] + (r.choice(passages) if r.random() < 0.6 else [])
        texts.append(" ".join(w))
    return texts


def judged(spark, ids, texts, **how):
    docs = spark.createDataFrame(list(zip(ids, texts)), DOCS)
    copies = docs.withColumn("c", (F.xxhash64(F.lit(how.get("seed", 0)), "text") % F.lit(1 << 31)).cast("int"))
    out = substring.substring_dedup(copies, digest=True, **how).select("doc_id", "c", "_out").collect()
    return sorted(map(tuple, out)), brute([(r.doc_id, r.c, r.text) for r in copies.collect()])


def test_rows_that_share_an_id_but_not_the_text(spark):
    texts = corpus(60, 1)
    got, expected = judged(spark, [k // 3 for k in range(60)], texts)
    assert got == expected


def test_false_hits_are_found_and_made_good(spark, monkeypatch):
    texts = corpus(50, 2)
    tries = []
    was = substring._verified
    monkeypatch.setattr(substring, "_verified", lambda known, cut: tries.append(was(known, cut)) or tries[-1])
    got, expected = judged(spark, range(50), texts, check_bits=1)
    assert got == expected and tries == [False, True]


def test_many_windows_around_one_phrase_and_frequent_anchors(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    phrase = [word() for _ in range(19)]
    texts = [" ".join([word(), *phrase, word(), *phrase[:9]]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).select(F.col("doc_id").alias("_id"), (F.xxhash64("text") % F.lit(1 << 31)).cast("int").alias("_copy"), F.col("text").alias("_text"))
    hot = substring.hot_anchors(docs)
    assert len(hot) >= 1
    rows = substring._map(6, 0, 64, hot)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(range(300), pa.int32()), pa.array(texts)], ["_id", "_copy", "_text"])
    sizes = {}
    for out in rows(iter([batch])):
        for kind, at, count in zip(out.column("kind").to_pylist(), out.column("range").to_pylist(), out.column("count").to_pylist()):
            if kind == substring.NEW:
                sizes[at] = sizes.get(at, 0) + int(np.frombuffer(count, np.int32).sum())
    assert max(sizes.values()) < 0.15 * sum(sizes.values())  # of 64 ranges
    assert {x._removed for x in substring.substring_dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()} == {0}


def test_runs_are_compacted_and_an_index_can_be_reopened(spark, tmp_path):
    texts = corpus(80, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).select(F.col("doc_id").alias("_id"), (F.xxhash64("text") % F.lit(1 << 31)).cast("int").alias("_copy"), F.col("text").alias("_text"))
    parts = [docs.where((F.col("_id") >= 16 * k) & (F.col("_id") < 16 * k + 16)) for k in range(5)]
    one = substring.FingerprintIndex(spark, 6, fanout=2)
    whole = [sorted(map(tuple, one.insert(p).collect())) for p in parts]
    assert one.compactions == 2 and len(one.runs) <= 2 and any(whole[1:])
    other = substring.FingerprintIndex(spark, 6, fanout=2)
    for p in parts[:4]:
        other.insert(p)
    other.save(str(tmp_path / "index"))
    again = substring.FingerprintIndex.open(spark, str(tmp_path / "index"))
    spread = lambda spans: {(d, s + k, o, t + k) for d, _, s, n, o, _, t in spans for k in range(n)}
    assert spread(map(tuple, again.insert(parts[4]).collect())) == spread(whole[4])
    one.drop()
    again.drop()


def test_the_query_compacts(spark, monkeypatch):
    done = []
    was = substring.FingerprintIndex.compact
    monkeypatch.setattr(substring.FingerprintIndex, "compact", lambda self: done.append(1) or was(self))
    substring.op5_substring(spark, "/root/testdata/sf0.001").count()
    assert done == [1]
