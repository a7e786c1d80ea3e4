import math
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import features as X
from millrace.operators import merge as M
from millrace.operators import nearcopies as D
from millrace.operators import retrieval as R
from millrace.sources import tables as S
from millrace.streaming import ingest as I


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_sources_keeps_the_first_source(spark):
    long = "x" * 80
    schema = "asin string, title string, author string, description string, idx int"
    first = spark.createDataFrame([("k1", "Dune (1)", "Frank Herbert", long, 0), ("k1", "Dune", "F. Herbert", long, 1), ("k2", "Short", "A B", "tiny", 2)], schema)
    second = spark.createDataFrame([("g1", "Dune: again", "Herbert, Frank", long, 0), ("g2", "Short", "B, Aa", long, 1), ("g3", "Other", "Cc", None, 2)], schema)
    out = M.merge_sources([first, second], "asin", "title", "author", "description", "idx")
    assert rows(out.select("asin", "source_rank")) == [("g2", 1), ("k1", 0)]


def test_shard_merge(spark):
    df = spark.createDataFrame([("a", "", 1, 0), ("a", "", 3, 1), ("b", "", 1, 0), ("b", "x", 1, 1)], "k string, v string, tries int, o int")
    assert rows(M.merge_shards(df, "k", "v", "tries", "o").select("k", "v", "tries")) == [("a", "", 3), ("b", "x", 1)]


def test_guard(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    with pytest.raises(ValueError, match="0.5000"):
        M.guard_coverage(df, "c")


def test_split_counts_and_determinism(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    first = X.split(df, "k", 0.2, 0.1)
    assert dict(first.groupBy("part").count().collect()) == {"train": 8, "test": 2}
    assert rows(first) == rows(X.split(df.repartition(3), "k", 0.2, 0.1))
    assert X.split(spark.range(11).withColumnRenamed("id", "k"), "k", 0.2, up=True).where("part = 'test'").count() == 3


def test_scalers_on_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert rows(X.Scaler.fit(df, ["a", "b"]).transform(df)) == [(-1.0, 0.0), (1.0, 0.0)]
    assert rows(X.Scaler.fit(df, ["a", "b"], "minmax").transform(df)) == [(0.0, 0.0), (1.0, 0.0)]


def test_unseen_label(spark):
    known = X.label_codes(spark.createDataFrame([("a",), ("b",)], "v string"), "v")
    with pytest.raises(Exception, match="unseen label: c"):
        X.encode_labels(spark.createDataFrame([("c",)], "v string"), "v", "code", known).collect()


def test_fill_missing_takes_nan_for_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0)], "id int, value double")
    assert rows(X.fill_missing(df, ["value"]))[1] == (2, 2.0)
    assert len(rows(X.fill_missing(df, ["value"], "drop"))) == 2


def test_smote_lies_between(spark):
    df = spark.createDataFrame([("a", k, float(k), 0.0) for k in range(20)] + [("b", 100 + k, float(k), 1.0) for k in range(5)], "label string, id int, x double, y double")
    out = X.smote(df, "label", "id", ["x", "y"]).collect()
    assert len(out) == 15 and all(r.label == "b" and 0 <= r.x <= 4 and r.y == 1.0 for r in out)


def test_isolation_finds_the_outlier(spark):
    df = spark.createDataFrame([(k, float(k % 10), float(k % 7)) for k in range(200)] + [(999, 500.0, 500.0)], "id int, x double, y double")
    assert X.isolation_scores(df, ["x", "y"]).orderBy(F.desc("isolation")).first()["id"] == 999


def test_rank_metrics(spark):
    out = R.rank_metrics(spark.createDataFrame([(0,), (1,), (4,)], "rank int")).first()
    assert out.recall_1 == pytest.approx(1 / 3) and out.mrr == pytest.approx(0.566667, abs=1e-6) and out.ndcg_5 == pytest.approx(0.672594, abs=1e-6)
    assert (out.median_rank, out.mean_rank) == (2, pytest.approx(8 / 3))


def test_search_and_index(spark, tmp_path):
    items = spark.createDataFrame([("a", "movie", [3.0, 0.0]), ("b", "book", [1.0, 1.0]), ("c", "movie", [0.0, 2.0])], "item_id string, domain string, embedding array<double>")
    R.write_index(items, str(tmp_path / "i"))
    assert [r.item_id for r in R.search(R.read_index(spark, str(tmp_path / "i")), [1.0, 0.1], 5).collect()] == ["a", "b", "c"]
    assert [r.item_id for r in R.search(R.read_index(spark, str(tmp_path / "i"), "movie"), [0.1, 1.0], 1).collect()] == ["c"]


def test_more_queries_than_a_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_QUERIES", 4)
    items = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(7)], "vec_id long, embedding array<double>")
    queries = items.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    got = sorted((r.q, r.vec_id) for r in R.scored(queries, items).collect())
    assert got == [(q, i) for q in range(7) for i in range(7)]


def test_losses(spark):
    pairs = spark.createDataFrame([(0, a, b, 1.0 if a == b else 0.0) for a in range(2) for b in range(2)], "batch int, q int, i int, s double")
    expected = math.log(1 + math.exp(-1 / 0.07))
    assert R.info_nce(pairs, "batch", "q", "i", "s").first()["loss"] == pytest.approx(expected)
    kl = R.batch_kl(spark.createDataFrame([(0, [math.log(0.5)] * 2, [math.log(0.25), math.log(0.75)])], "b int, p array<double>, t array<double>"), "b", "p", "t").first()["loss"]
    assert kl == pytest.approx(0.25 * math.log(0.5) + 0.75 * math.log(1.5))


def test_early_stopping(spark):
    values = [3.0, 2.0, 2.0, 2.5, 2.1, 1.0]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)], "g string, o int, v double")
    out = E.early_stopping(df, "g", "o", "v").orderBy("o").collect()
    assert [r.misses for r in out] == [0, 0, 1, 2, 3, 0] and [r.stopped for r in out] == [False] * 4 + [True] * 2


def test_upper_median(spark):
    got = [E.upper_median(spark.createDataFrame([(x,) for x in range(n)], "v int"), "v").first()["upper_median"] for n in (1, 2, 3, 4, 5)]
    assert got == [sorted(range(n), reverse=True)[n // 2] for n in (1, 2, 3, 4, 5)]


def test_minhash_against_plain_python(spark):
    import zlib

    text = "one two three four five six seven"
    words = text.split()
    grams = {" ".join(words[k : k + 5]) for k in range(3)}
    a, b = D.coefficients()
    expected = [min((x * (zlib.crc32(g.encode()) & 0x7FFFFFFF) + y) % D.PRIME for g in grams) for x, y in zip(a, b)]
    from millrace.functions import text as T

    assert spark.createDataFrame([(text,)], "t string").select(D.signature(T.shingles(F.col("t"))).alias("s")).first()["s"] == expected
    empty = spark.createDataFrame([("",)], "t string").select(D.signature(T.shingles(F.col("t"))).alias("s")).first()["s"]
    assert empty == [D.PRIME] * 32


def test_near_copies(spark):
    base = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, base), (2, base + " more"), (3, "other words altogether here now"), (4, base)], "id int, t string")
    assert [(r.a, r.b) for r in D.near_copies(df, "id", "t").collect()] == [(1, 2)]
    assert [(r.a, r.b) for r in D.exact_jaccard_pairs(df, "id", "t", 0.8).collect()] == [(1, 2)]


def test_every_pair_of_a_large_bucket_meets(spark):
    words = [f"w{k}" for k in range(400)]
    df = spark.createDataFrame([(k, " ".join(words[:k] + [f"x{k}"] + words[k:])) for k in range(0, 400, 20)], "id int, t string")
    small, whole = ({(r.a, r.b) for r in D.candidates(df, "id", "t", n).collect()} for n in (3, 1000))
    assert small == whole and len(whole) > 100


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", 'line one\nline "two", end'), ("2", None)], "id string, t string")
    S.write_csv(df, str(tmp_path / "c"))
    assert rows(S.read_csv(spark, str(tmp_path / "c")).na.fill("-")) == rows(df.na.fill("-"))
    (tmp_path / "a.json").write_text('{"x": {"desc": "d", "tries": 2}, "y": "old form", "z": ""}')
    assert rows(S.read_tries_cache(spark, str(tmp_path / "a.json")).drop("file")) == [("x", "d", 2), ("y", "old form", 1), ("z", "", 1)]
    S.append_checkpoint(df, str(tmp_path / "p"), "id")
    assert S.append_checkpoint(df, str(tmp_path / "p"), "id").count() == 2
    assert S.versioned_overwrite(df, str(tmp_path / "v"), date(2024, 1, 2), dry_run=True)["rows"] == 2 and not (tmp_path / "v").exists()
    S.write_cache(df.na.fill(""), str(tmp_path / "k"), "id", "t")
    assert {r.key for r in S.read_cache(spark, str(tmp_path / "k")).collect()} == {"1", "2"}


def test_fetching_and_generating_isolate_failures(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("no route")
        return "ok"

    df = spark.createDataFrame([(1, "http://a/x"), (2, "http://bad/x")], "id int, url string")
    assert rows(S.fetched(df, "id", "url", fetch, 2)) == [(1, "ok", None), (2, None, "OSError: no route")]

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    assert rows(S.generated(df, "id", "url", model)) == [(1, "HTTP://A/X", None), (2, None, "ValueError: refused")]


def test_sample_catalog_is_fixed(spark):
    assert rows(S.sample_catalog(spark, 20)) == rows(S.sample_catalog(spark, 20))


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(k % 5, f"v{k}") for k in range(10)], "k int, v string")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for turn in range(2):
        I.ingest(stream, str(tmp_path / "out"), "k", str(tmp_path / f"check{turn}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_numbering_matches_a_plain_order(spark):
    df = spark.createDataFrame([(k, k * 37 % 101 if k % 9 else None, "x" if k % 3 else None) for k in range(300)], "id int, v int, g string")
    key = lambda r: (r.v is not None, r.v or 0, r.id)
    plain = sorted(df.collect(), key=key)
    assert {r.id: r.place for r in X.numbered(df, F.col("v"), F.col("id")).collect()} == {r.id: k for k, r in enumerate(plain)}
    within = {r.id: r.place for r in X.numbered(df, F.col("v"), F.col("id"), by=["g"]).collect()}
    for g in ("x", None):
        assert [within[r.id] for r in plain if r.g == g] == list(range(len([r for r in plain if r.g == g])))
    assert X.numbered(df.limit(0), F.col("v")).count() == 0


def test_lookup_takes_whole_rows_and_the_last(spark):
    cache = spark.createDataFrame([(1, "a", 9, 1), (1, "b", 2, 3), (1, "c", 5, 2), (2, None, 1, 1)], "k int, x string, y int, at int")
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert sorted(map(tuple, M.lookup(df, cache, "k", order="at").collect())) == [(1, "b", 2), (2, None, 1), (3, None, None)]
    assert {tuple(r) for r in M.lookup(df, cache.drop("at"), "k").collect()} == {(1, "c", 5), (2, None, 1), (3, None, None)}


def test_checkpoint_takes_rows_without_a_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    path = str(tmp_path / "done")
    for _ in range(3):
        assert S.append_checkpoint(rows, path, "k").count() == 2
    (tmp_path / "empty").mkdir()
    assert S.append_checkpoint(rows, str(tmp_path / "empty"), "k").count() == 2


def test_exact_pairs_are_those_of_brute_force(spark):
    draw = random.Random(5)
    texts = []
    for n in [*range(1, 40), 60, 90, 150, 400, 900]:
        base = [f"w{draw.randrange(5000)}" for _ in range(n)]
        for changed in (0, 1, 1, 2, n // 40, n // 25, n // 25, n // 20):
            other = list(base)
            for _ in range(changed):
                other[draw.randrange(len(other))] = f"y{draw.randrange(9)}"
            texts.append(" ".join(other[: draw.choice([n, n, n - n // 30, n - n // 6])] or base))
        texts += [" ".join(base).upper(), " ".join(base), " ".join(base[: n // 2] + ["the same closing words stand here"])]
    texts += ["", None, "...", " ".join(f"w{k % 7}" for k in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t, k)
    sets = {}
    for t, k in first.items():
        w = re.findall("[a-z0-9']+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    every = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x & y}
    for least, few, cap in ((0.8, 32, 512), (0.8, 2, 3), (0.5, 4, 5)):
        got = {(r.a, r.b): r.jaccard for r in D.exact_jaccard_pairs(df, "id", "t", least, few, cap).collect()}
        assert got == {p: j for p, j in every.items() if j >= least}


def test_exact_pairs_shuffle_less_than_the_texts(spark):
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(100_000)}" for _ in range(500)) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *(f"{t} more" for t in texts[:20])])], "id long, t string")
    jvm, store = spark.sparkContext._gateway.jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    assert D.exact_jaccard_pairs(df, "id", "t", 0.8).count() == 20
    assert written() - before < 2 * sum(map(len, texts))
