"""The training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import common, forest, hmm, language, licences, mixing, packing, repetition, simhash, sitetree, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empties, repeats, a long text, rows that share an id, and columns whose names clash."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", None, 0), (3, long, "en", "s", 1), (4, long, None, "s", 1), (4, long, "de", "s", 1), (5, " \n ", "en", "s", 3), (6, "### 123", "en", "s", 7)]
    return spark.createDataFrame(rows, DOCS).withColumns({"_id": F.lit("x"), "fp": F.lit(1), "node": F.lit(2), "word": F.lit(3), "_lang": F.lit(4), "score": F.lit(5), "_text": F.lit(6), "c0": F.lit(7)})


def components_of(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    expected = components_of(pairs, {n for p in pairs for n in p if p[0] != p[1]})
    assert got == expected
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_blocks_meet_once(spark):
    df = spark.createDataFrame([(k % 2, k) for k in range(60)], "key int, v long")
    seen = Counter()
    for row in common.pair_blocks(df, ["key"], ["v"], "v", 7).collect():
        m = row.members
        for i in range(len(m)):
            for j in range(i):
                if row.lo == row.hi or m[i].chunk != m[j].chunk:
                    seen[frozenset((m[i].v, m[j].v))] += 1
    assert seen == Counter(frozenset((a, b)) for a in range(60) for b in range(a) if a % 2 == b % 2)


# --- SimHash ----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_all_pairs(spark, small):
    base = [r.text for r in small.collect()]
    r = random.Random(3)
    texts = base + [" ".join(w if r.random() > 0.003 else "zzz" for w in t.split(" ")) for t in base[:60]] + ["", None, "x"]
    got = simhash.simhash_components(docs_of(spark, texts), shingle=4, most_bits=4).collect()
    fps = {k: plain_fingerprint(t, 4) for k, t in enumerate(texts)}
    assert {x.id: int.from_bytes(x.fp, "little") for x in got} == fps
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {x.id: x.component for x in got} == components_of(links, fps)
    assert len(links) > 30


def test_pivots_discard_no_link():
    draw = np.random.default_rng(2)
    fps = draw.integers(0, 2**64, (300, 1), dtype=np.uint64)
    for k in range(100):
        for b in draw.choice(64, draw.integers(0, 6), replace=False):
            fps[200 + k, 0] = fps[200 + k, 0] if b is None else fps[k, 0] ^ np.uint64(1 << int(b))
    table = simhash.distances(fps, simhash.references(24, 1, 7)).astype(np.int16)
    got = set(simhash.linked(fps, table, np.zeros(300), True, 4))
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 4}

    edges = list(simhash.spanning(fps, table, np.zeros(300), True, 4))
    assert set(edges) <= got and components_of(edges, range(300)) == components_of(got, range(300))


def test_near_dedup_by_similarity(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(200)) for _ in range(60)]
    copies = []
    for t in texts[:30]:
        words = t.split()
        words[r.randrange(200)] = "changed"
        words[r.randrange(200)] = "twice"
        copies.append(" ".join(words))
    kept = {x.doc_id for x in simhash.near_dedup(docs_of(spark, texts + copies + texts[:5])).collect()}
    assert kept == set(range(60))


def test_near_dedup_keeps_what_is_below_the_similarity(spark):
    r = random.Random(14)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = []
    for k in range(40):
        words = [word() for _ in range(204)]
        other = words[:]
        # the five shingles round a changed word differ: 200 - d shared of 200 + d, similar at d <= 22
        d = (15, 20, 25, 35)[k % 4]
        for p in range(10, 10 + 10 * (d // 5), 10):
            other[p] = word()
        texts += [" ".join(words), " ".join(other)]
    texts += ["a b c d e f " * 40 + "x y", "a b c d e f " * 40 + "p q r s t u v w"]  # one fingerprint's majority, other sets
    docs = docs_of(spark, texts)
    sets = {k: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for k, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = components_of(links, sets)
    assert len(links) == 20
    assert {x.doc_id for x in simhash.near_dedup(docs).collect()} == {k for k in expected if expected[k] == k}


def test_similar_sets_against_all_pairs():
    draw = np.random.default_rng(15)
    base = [draw.integers(0, 2**64, 40, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.r_[base[k % 4][: draw.integers(28, 41)], draw.integers(0, 2**64, draw.integers(0, 8), dtype=np.uint64)]) for k in range(60)]
    sets.append(np.empty(0, np.uint64))
    chunk = np.arange(61) % 3
    for same in (True, False):
        jaccard = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
        links = [(i, j) for i in range(61) for j in range(i + 1, 61) if (same or chunk[i] != chunk[j]) and jaccard(sets[i], sets[j]) >= 0.8]
        edges = list(simhash.similar(sets, chunk, same, 0.8))
        assert set(edges) <= set(links) and components_of(edges, range(61)) == components_of(links, range(61))


def test_simhash_edges(spark, hard):
    out = simhash.simhash_components(hard).collect()
    assert len(out) == hard.count()
    same = {x.component for x in out if x.id in (3, 4)}
    assert same == {3}
    assert {x.component for x in out if x.id in (1, 2, 5)} == {1}
    kept = simhash.near_dedup(hard)
    assert kept.columns == hard.columns and {x.doc_id for x in kept.select("doc_id").collect()} == {None, 1, 3, 6}
    assert simhash.simhash_components(hard.limit(0)).count() == 0


# --- language ---------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", common.id_remainder(F.col("doc_id"), 3) == 1)
    model = language.fit(docs.where("NOT held"))
    out = language.identify(docs.where("held"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}


def test_language_edges(spark, hard, small):
    model = language.fit(small)
    out = language.identify(hard, model)
    assert [c for c in out.columns if c not in ("lang_pred", "score")] == [c for c in hard.columns if c != "score"]
    assert sorted(r.doc_id for r in out.where("lang_pred = 'und'").collect()) == [1, 2, 5, 6]
    nothing = language.fit(small.limit(0))
    assert {r.lang_pred for r in language.identify(hard, nothing).collect()} == {"und"}
    one = language.fit(small.where("lang = 'es'"))
    assert {r.lang_pred for r in language.identify(small, one).collect()} == {"es"}
    assert language.identify(hard.limit(0), model).count() == 0


def test_held_out_condition(spark):
    rows = spark.range(50).select("id", common.id_remainder(F.col("id"), 3).alias("r")).collect()
    assert all(x.r == zlib.crc32(str(x.id).encode()) % 3 for x in rows)


# --- pages ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><body><nav><a>menu</a></nav><article><h1>T</h1><p><b>One<br><p>Two &amp; three</article><footer>x</footer>", "T\nOne\nTwo & three"),
        ("<body><div class='cookie-notice'>We use</div><main><header><h1>Head</h1></header><p>a  \n b</p><aside>side</aside></main><div id=comments><p>first!</p></div>", "Head\na b"),
        ("<p>no article<script>var t='</p>';</script><style>p{}</style><form>Search <input></form><!-- <p>x --> here", "no article\nhere"),
        ("<article><ul><li>one<li>two</ul><div class='ad'>buy</div><div class=article-header>kept?</div><p hidden>h</p></article>", "one\ntwo"),
        ("<article><p>cut in a tag</a", "cut in a tag"),
        ("<article>1 < 2 and &lt;b&gt; &#233;</article>", "1 < 2 and <b> é"),
        ("<div class='layout with-sidebar'><article class=post><p>in</p></article><section id=comments><article class=comment><p>me too</p></article></section></div>", "in"),
        ("", ""),
        ("plain", "plain"),
        ('<p title="abc>text here</p>', "text here"),
    ],
)
def test_main_text(html, text):
    assert sitetree.main_text(html, frozenset()) == text


def test_site_tree_removes_what_all_pages_share(spark):
    page = lambda k: f"<body><div class=top><p>Welcome to our site</p></div><div class=body><p>Story number {k} alone</p><p>More of {k}</p></div><div class=end><p>Call us now</p></div></body>"
    rows = [(k, "http://a.example/x", page(k)) for k in range(20)] + [(90, "http://b.example/", page(90)), (91, None, None), (92, "nonsense", "<p>x</p>")]
    out = {r.page_id: r for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k].text == f"Story number {k} alone\nMore of {k}" for k in range(20))
    assert out[90].text.startswith("Welcome") and (out[91].text, out[91].n_chars, out[91].url) == ("", 0, None) and out[92].text == "x"
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_importance_against_plain_entropies(spark):
    r = random.Random(17)
    said = [f"line {k}" for k in range(6)]
    sources = [f"<div class=a><p>{r.choice(said[:2])}</p></div><div class=b><p>own {k}</p><ul><li>{r.choice(said)}</li></ul>{'<h2>x</h2>' if r.random() < 0.3 else ''}</div><div class=c><span>same</span></div>" for k in range(30)]
    pages = spark.createDataFrame([(k, "http://h.example/", x) for k, x in enumerate(sources)], "page_id long, url string, html string")
    trees = [sitetree.Page(x) for x in sources]
    contents, looks, above = {}, {}, {}
    for t in trees:
        for path, text in {(b[0], b[4]) for b in t.blocks}:
            contents.setdefault(path, Counter())[text] += 1
        for path, chain, *_ in t.blocks:
            above.update({path: chain[-2] if len(chain) > 1 else 0} | dict(zip(chain[1:], chain)))
        for path, tags in t.shapes.items():
            if path:
                looks.setdefault(path, Counter())[" ".join(dict.fromkeys(tags))] += 1
    for p in looks:
        above.setdefault(p, 0)

    def entropy(counts, base):
        n = sum(counts)
        return -sum(c / n * math.log(c / n) for c in counts) / math.log(base)

    def judged(p):
        """(composite importance, the largest inside)"""
        under = [judged(c) for c in looks if above[c] == p]
        look = entropy(looks[p].values(), 30)
        inner = (1 - 0.9 ** len(under)) * sum(x for x, _ in under) / len(under) + 0.9 ** len(under) * look if under else look
        # A content shown on n of the pages, equally often on each, has the entropy log n.
        value = 1 - sum(math.log(n) for n in contents[p].values()) / len(contents[p]) / math.log(30) if p in contents else inner
        return value, max([value, *(m for _, m in under)])

    for low in (0.05, 0.3, 0.6):
        expected = {p for p in looks if (30 * judged(p)[1] + 0.2) / 30.2 < low}
        got = sitetree_low(spark, pages, low)
        assert got == expected
    assert expected


def sitetree_low(spark, pages, low):
    seen = pages.select("url", "html").mapInArrow(sitetree._observe, "host string, path long, above long, feature long, n long")
    counts = seen.groupBy("host", "path", "above", "feature").agg(F.sum("n").alias("n"))
    nodes = counts.groupBy("host", "path", "above", (F.col("feature") % 2 == 0).alias("content")).agg(F.sum("n").alias("shown"), F.count(F.lit(1)).alias("features"), F.sum(F.log("n")).alias("log_n"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
    return {r.path for r in nodes.groupBy("host").applyInArrow(sitetree._importance(0.9, low, 0.2), "host string, path long").collect()}


def test_site_tree_spares_a_host_of_copies(spark):
    rows = [(k, "http://c.example/", "<div><p>All the same</p></div>") for k in range(12)]
    assert {r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"All the same"}


def test_site_tree_empty(spark):
    assert sitetree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- hidden Markov model ----------------------------------------------------------------------------------------------


def test_forward_and_counts_against_all_paths():
    from itertools import product

    draw = np.random.default_rng(1)
    start = draw.random(2)
    start /= start.sum()
    move = draw.random((2, 2))
    move /= move.sum(axis=1, keepdims=True)
    emit = draw.random((3, 2))
    emit /= emit.sum(axis=0)
    sequences = [np.array(s, np.int32) for s in ([0, 1, 2, 2], [1], [2, 0, 1, 1, 0], [0, 0])]
    got = hmm.log10_likelihoods(sequences, start, move, emit)
    first, moves, emitted, reached = hmm.expected_counts(sequences, start, move, emit)
    assert reached == pytest.approx(got.sum() * math.log(10))
    f, m, e = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for s, value in zip(sequences, got):
        paths = {}
        for p in product(range(2), repeat=len(s)):
            w = start[p[0]] * emit[s[0], p[0]]
            for t in range(1, len(s)):
                w *= move[p[t - 1], p[t]] * emit[s[t], p[t]]
            paths[p] = w
        total = sum(paths.values())
        assert value == pytest.approx(math.log10(total))
        for p, w in paths.items():
            f[p[0]] += w / total
            for t, k in enumerate(p):
                e[s[t], k] += w / total
                if t:
                    m[p[t - 1], k] += w / total
    assert np.allclose(first, f) and np.allclose(moves, m) and np.allclose(emitted, e)


def test_hmm_base_scores_and_gain(spark, small):
    out = {r.doc_id: r for r in hmm.score(small.select("doc_id", "text"), common.id_remainder(F.col("doc_id"), 10) != 0, head_words=500).collect()}
    texts = {r.doc_id: r.text.encode().lower().split() + [b" "] for r in small.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in counts for w in t), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hmm_edges(spark, hard):
    out = hmm.score(hard, F.lit(True), head_words=50).collect()
    assert len(out) == hard.count() and all(math.isfinite(r.score) for r in out)
    assert all(r.n_tokens == 1 for r in out if r.doc_id in (1, 2, 5))
    unknown = hmm.score(hard, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in unknown)
    assert hmm.score(hard.limit(0), F.lit(True)).count() == 0


# --- substrings -------------------------------------------------------------------------------------------------------


def brute_substrings(texts):
    seen, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    for i, w in split.items():
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            seen[key] = min(seen.get(key, (i, s)), (i, s))
    for i, w in split.items():
        gone = {p for s in range(len(w) - 19) if seen[tuple(w[s : s + 20])] < (i, s) for p in range(s, s + 20)}
        out[i] = [x for p, x in enumerate(w) if p not in gone]
    return out


@pytest.mark.parametrize("cuts", [(), (0.25,), (0.2, 0.4, 0.6, 0.8)])
def test_substrings_against_brute_force(spark, cuts):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(500)}"
    passages = [[word() for _ in range(r.choice([15, 20, 21, 60]))] for _ in range(8)]
    texts = {}
    for i in range(80):
        w = []
        for _ in range(r.randrange(0, 5)):
            w += [word() for _ in range(r.randrange(0, 40))] + (r.choice(passages) if r.random() < 0.7 else [])
        if r.random() < 0.1:
            w += ["a"] * 50
        texts[i] = " ".join(w)
    texts[80], texts[81] = texts[5], None
    df = docs_of(spark, list(texts.values()), list(texts))
    expected = brute_substrings(texts)
    got = {x.doc_id: x for x in substring.substring_dedup(df, cuts=cuts, fanout=2, digest=True).collect()}
    for i, kept in expected.items():
        total = len((texts[i] or "").split())
        assert (got[i]._words, got[i]._removed, got[i]._out) == (total, total - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), i
    cut = {x.doc_id: x.text for x in substring.substring_dedup(df, cuts=cuts).collect()}
    assert all(cut[i] == (texts[i] if texts[i] is None or len(k) == len(texts[i].split()) else b" ".join(k).decode()) for i, k in expected.items())


def test_windows_at_one_anchor_are_told_apart(spark):
    r = random.Random(16)
    word = lambda: f"w{r.randrange(10**5)}".encode()
    hashed = lambda ws: int(substring._mixed(substring._rolled(np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64), 6))[0])
    phrase = min(([word() for _ in range(6)] for _ in range(20_000)), key=hashed)
    docs = [[word() for _ in range(14)] + phrase + [word() for _ in range(14)] for _ in range(20_000)]
    seen, texts = {}, []
    for k, words in enumerate(docs):
        anchor, check = substring.fingerprints(words)
        half = check >> np.uint64(32) if check.dtype == np.uint64 else check
        for s, key in enumerate(zip(anchor.tolist(), half.tolist())):
            other, at = seen.setdefault(key, (k, s))
            if docs[other][at : at + 20] != words[s : s + 20]:
                texts += [b" ".join(docs[other]).decode(), b" ".join(words).decode()]
    assert texts  # different windows that agree in the anchor and in 32 bits
    for cuts in ((), (0.5,)):
        assert {x._removed for x in substring.substring_dedup(docs_of(spark, texts), cuts=cuts).collect()} == {0}


def test_substring_edges(spark, hard):
    out = substring.substring_dedup(hard)
    assert out.columns == [*hard.columns, "_words", "_removed"]
    rows = {(r.doc_id, r.lang): r for r in out.collect()}
    assert rows[3, "en"]._removed == 0 and rows[4, None]._removed == rows[4, "de"]._removed == 30_000
    assert rows[1, None].text is None and rows[None, "en"].text == "a b c"
    assert substring.substring_dedup(hard.limit(0)).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


def test_first_fit_decreasing_against_plain():
    r = random.Random(6)
    for _ in range(50):
        lengths = np.array([r.randint(1, 50) for _ in range(r.randint(1, 80))])
        bin_, offset = packing.first_fit_decreasing(lengths, 50)
        bins = []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            at = next((b for b, used in enumerate(bins) if used + lengths[k] <= 50), None)
            if at is None:
                bins.append(0)
                at = len(bins) - 1
            assert (bin_[k], offset[k]) == (at, bins[at])
            bins[at] += lengths[k]


def test_fast_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.tokenizer(None)
    r = random.Random(7)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x400), 0x4E2D, 0x1F600, 0x0301, 0x200B, 0x2003, 0xFFFD, 0x0660, 0x2167]]
    texts = ["", "a<|endoftext|>b", "it's 12's   \n\n x ", *("".join(r.choices(pool, k=r.randint(1, 200))) for _ in range(300))]
    assert all(list(fast(t)) == slow.encode(t, add_special_tokens=False).ids for t in texts)


def test_packing_round_trip(spark, small, hard):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (small, hard):
        rows = packing.pack(df, group_docs=50).collect()
        sequences = {}
        for p in rows:
            sequences.setdefault(p.sequence_id, []).append(p)
        for pieces in sequences.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048
        assert sum(p.length for p in rows) == sum(len(slow.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in df.select("text").collect())
    pieces = {}
    for p in packing.pack(small).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    for d in small.collect():
        ids = np.array([*slow.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack(small.limit(0)).count() == 0


# --- licences ---------------------------------------------------------------------------------------------------------


def test_licences(spark, hard):
    mit = licences.TEMPLATES["mit-permission"].replace(". ", ".\n", 1).replace("restriction, ", "restriction,\n")
    texts = ["Prose.\nReleased under the  MIT licence? no\nReleased under the MIT License.\nEnd.", f"Intro\n\n{mit}\n\nOutro", "license", None, "", "ALL RIGHTS RESERVED"]
    out = {(r.doc_id, r.segment, r.number, r.licence): r.dice for r in licences.scan(docs_of(spark, texts)).collect()}
    assert out[0, "line", 3, "mit"] == 1.0 and out[1, "paragraph", 2, "mit-permission"] == 1.0 and out[5, "line", 1, "all-rights-reserved"] == 1.0
    assert {k[0] for k in out} == {0, 1, 5}
    assert licences.scan(hard).count() == 0 and licences.scan(hard.limit(0)).count() == 0


def test_embedded_and_split_notices(spark):
    t = licences.TEMPLATES
    apache = t["apache-2.0-header"].replace("at http", "at\n\n    http").replace("2.0 Unless", "2.0\n\nUnless")
    texts = ["Some prose first. Released under the MIT License. Four more words follow", f"Copyright me. {apache} int main() {{ return 0; }} " + "more(code); " * 200, f"// head\n{t['bsd-3-clause']}\nAnd prose. " + "More prose. " * 50, t["mit-text"], "Nothing to see. At all."]
    out = {}
    for r in licences.scan(docs_of(spark, texts)).collect():
        out.setdefault((r.doc_id, r.licence), []).append((r.dice, r.segment, r.number, r.sentences))
    assert (1.0, "run", 2, 1) in out[0, "mit"]
    assert max(out[1, "apache-2.0-header"])[0] > 0.95 and max(out[2, "bsd-3-clause"])[0] > 0.9 and max(out[3, "mit-text"])[0] == 1.0
    assert not any(k[0] == 4 for k in out)


def test_licences_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    mine = sorted(tuple("" if v is None else str(v) for v in r) for r in licences.op7_licences(spark, "/root/testdata/sf0.001").select("doc_id", "segment", "number", "sentences", "licence", "dice").collect())
    got = con.execute(f"SELECT doc_id, segment, number, sentences, licence, dice FROM ({licences.SQL})").fetchall()
    assert mine == sorted(tuple("" if v is None else str(v) for v in r) for r in got) and mine


def test_witnesses_lose_no_match():
    grams = {n: licences.template_grams(t) for n, t in licences.TEMPLATES.items()}
    words = licences.witnesses(grams, 0.8)
    for g in grams.values():
        without = [x for x in g if not any(w in x.split() for w in words)]
        assert len(without) < 0.8 / 1.2 * len(g)


# --- embeddings -------------------------------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark):
    draw = np.random.default_rng(8)
    x = draw.standard_normal((400, 16))
    x[200:300] = x[:100] + 0.08 * draw.standard_normal((100, 16))
    x[300:360] = x[0] + 0.05 * draw.standard_normal((60, 16))
    x[360:380] = x[0]
    x[380:390] = 3 * x[0]
    rows = [(k, [float(v) for v in x[k]], int(k % 2) if k % 50 else None) for k in range(400)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0], 1), (None, [float(v) for v in x[0]], 0), (905, [], 0)]
    out = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf_rows=20, cap=16).collect()
    got = {r.id: r for r in out}
    assert len(out) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    label = [r[2] for r in rows]
    links = [(a, b) for a in range(400) for b in range(a) if label[a] is not None and label[a] == label[b] and cos[a, b] >= 0.93]
    degree = Counter(n for p in links for n in p)
    missed = sum(degree[k] - got[k].n_links for k in range(400))
    assert 0 <= missed <= 0.1 * 2 * len(links) and all(got[k].n_links <= degree[k] for k in range(400))
    if not missed:
        assert {k: got[k].component for k in range(400)} == components_of(links, range(400))
    for k in (900, 901, 902, 903, 904, 905):
        assert (got[k].n_links, got[k].component) == (0, k)
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_trees_do_not_grow_with_the_vectors():
    import pickle

    draw = np.random.default_rng(9)
    sample = draw.standard_normal((2000, 16))
    size = [len(pickle.dumps([forest.Tree(sample, levels, 0.15, 1)])) for levels in (10, 24)]
    assert size[1] - size[0] < 14 * 600  # a direction and two numbers for each further level
    row, leaf = forest.Tree(sample, 24, 0.15, 1).leaves(sample[:100])
    assert set(row.tolist()) == set(range(100)) and leaf.max() < 1 << 24


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 40), ("b", "y", 20)], "s string, l string, tokens long")
    want = {"s": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double"), "l": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "value string, share double")}
    out = mixing.raked(cells, ["s", "l"], want, rounds=40)
    assert {r.s: pytest.approx(r.w, rel=1e-6) for r in out.groupBy("s").agg(F.sum("weight").alias("w")).collect()} == {"a": 50.0, "b": 50.0}
    assert {r.l: pytest.approx(r.w, rel=1e-6) for r in out.groupBy("l").agg(F.sum("weight").alias("w")).collect()} == {"x": 20.0, "y": 80.0}
    p = mixing.calibrated(out, 0.6).collect()
    assert sum(r.probability * r.tokens for r in p) == pytest.approx(60) and max(r.probability for r in p) <= 1


def test_mixing_edges(spark, hard, small):
    out = mixing.mix(hard)
    assert out.columns[: len(hard.columns)] == hard.columns and out.count() == hard.count()
    assert mixing.mix(hard.limit(0)).count() == 0
    kept = mixing.mix(small, share=0.5).agg(F.sum(F.when(F.col("_kept"), F.col("_tokens"))) / F.sum("_tokens")).first()[0]
    assert 0.3 < kept < 0.7


# --- repetition -------------------------------------------------------------------------------------------------------


def brute_repetition(text, least):
    w = text.encode().split()
    n = len(w)
    inside, longest = [False] * n, 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            longest = max(longest, best)
            inside[i : i + best] = [True] * best
    triples = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    again = [False] * n
    for i in range(n - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (n, sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(again), sum(inside), longest)


def test_repetition_against_brute_force():
    r = random.Random(9)
    for _ in range(120):
        texts = ["".join(r.choice(["a", "b", "c#", "dé", "\x1c"][: r.randint(1, 5)]) + r.choice([" ", "\n", "  ", "\t", "\xa0"]) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        for least in (2, 3, 8):
            assert repetition.measure(texts, least) == [brute_repetition(t, least) for t in texts]


def test_repetition_verdicts(spark, hard):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join(words[:100] * 2), " ".join(words[:60] + words[:25] + words[60:150]), "short", None, " ".join(["la"] * 400)]
    out = {r.doc_id: r for r in repetition.repetition(docs_of(spark, texts)).collect()}
    assert [out[k].base_failed for k in range(6)] == [False, True, False, True, True, True] and out[2].n_covered == 50
    assert out[0].kept and not out[1].kept and not out[5].kept and out[4].n_words == 0
    assert repetition.repetition(hard).count() == hard.count() and repetition.repetition(hard.limit(0)).count() == 0
