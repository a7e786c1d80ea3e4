"""One query for each catalog operator over the driver's tables, with the SQL that states the same result.

Names begin with the operators' numbers in the survey. Every computed number is rounded, every order total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions import numbers as N
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import merge as M
from ..operators import nearcopies as D
from ..operators import retrieval as R
from ..sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(t) -> DataFrame, t(table) reading one of the tables."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def six(c):
    return F.round(c, 6)


# --- scans, projections, predicates -----------------------------------------------------------------------------------


@query("S2_column_pruning", "SELECT p_partkey, p_name FROM part")
def _(t):
    return t("part").select("p_partkey", "p_name")


@query("S18_limit_in_order", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def _(t):
    return t("documents").select("doc_id", "source").orderBy("doc_id").limit(50)


@query("S5_json_column", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("S13_boards", """SELECT label, '[' || string_agg('{"v":' || vec_id || '}', ',' ORDER BY vec_id) || ']' AS json FROM (
    SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 12 GROUP BY label""")
def _(t):
    return S.boards(t("embeddings"), "label", "vec_id", F.struct(F.col("vec_id").alias("v")))


@query("S15_content_digest", "SELECT doc_id, strlen(text) AS size, md5(text) AS md5 FROM documents")
def _(t):
    return t("documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("F1_blank", "SELECT doc_id, lang IS NULL OR trim(CASE WHEN doc_id % 7 = 0 THEN ' nan ' WHEN doc_id % 5 = 0 THEN NULL ELSE lang END) IN ('', 'nan', 'None') OR (doc_id % 5 = 0 AND doc_id % 7 <> 0) AS is_blank FROM documents")
def _(t):
    c = F.when(F.col("doc_id") % 7 == 0, " nan ").when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lang"))
    return t("documents").select("doc_id", T.blank(c).alias("is_blank"))


@query("F2_clean", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS cleaned FROM documents")
def _(t):
    c = F.when(F.col("doc_id") % 6 == 0, " [] ").when(F.col("doc_id") % 3 == 0, "no").otherwise(F.concat(F.lit(" "), F.col("source"), F.lit(" ")))
    return t("documents").select("doc_id", T.clean(c).alias("cleaned"))


@query("F3_domain_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def _(t):
    return t("documents").where(F.col("lang") == "de").select("doc_id", "lang")


@query("F4_text_present", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''")
def _(t):
    return t("conversations").where(F.col("text").isNotNull() & (F.trim("text") != "")).select("conv_id", "turn")


@query("F6_length_before_dedup", "SELECT text, min(doc_id) AS doc_id FROM documents WHERE length(text) >= 80 GROUP BY text")
def _(t):
    return M.first_by(t("documents").where(F.length("text") >= 80).select("text", "doc_id"), ["text"], "doc_id")


@query("F7_url_valid", "SELECT page_id, url LIKE 'http%' AND url NOT IN ('no', 'nan') AS ok FROM pages")
def _(t):
    return t("pages").select("page_id", (F.col("url").startswith("http") & ~F.col("url").isin("no", "nan")).alias("ok"))


@query("F8_placeholder", "SELECT page_id, strlen(html) >= 3000 OR (strlen(html) >= 1024) AS ok FROM pages")
def _(t):
    return t("pages").select("page_id", S.image_ok(F.col("html").cast("binary"), F.lit(200), []).alias("ok"))


@query("F9_row_membership", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t("documents").select("doc_id", "source").join(t("labels").where("quality = 1"), "doc_id", "left_semi")


@query("F10_priority_coalesce", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN lang END, CASE WHEN toxic = 1 THEN source END, '') AS picked FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    j = t("documents").join(t("labels"), "doc_id", "left")
    return j.select("doc_id", T.priority(F.when(F.col("quality") == 1, F.col("lang")), F.when(F.col("toxic") == 1, F.col("source"))).alias("picked"))


@query("F11_conditional_block", "SELECT p_partkey, 'Name: ' || p_name || CASE WHEN p_size > 25 THEN chr(10) || 'Size: ' || p_size ELSE '' END AS block FROM part")
def _(t):
    return t("part").select("p_partkey", T.labelled(Name=F.col("p_name"), Size=F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))).alias("block"))


@query("F13_coverage_guard", "SELECT round(avg(CASE WHEN trim(text) NOT IN ('', 'nan', 'None') THEN 1.0 ELSE 0 END), 6) AS share FROM documents")
def _(t):
    docs = t("documents")
    share = M.guard_coverage(docs, "text", 0.5)
    return docs.sparkSession.range(1).select(F.round(F.lit(share), 6).alias("share"))


@query("F14_bad_query", r"SELECT doc_id, len(string_split(q, '|')) <> 3 OR regexp_matches(q, '^\d+\.') AS bad FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '1. a|b|c' WHEN doc_id % 4 = 1 THEN lang || '|' || source ELSE lang || '|' || source || '|x' END AS q FROM documents)")
def _(t):
    q = F.when(F.col("doc_id") % 4 == 0, "1. a|b|c").when(F.col("doc_id") % 4 == 1, F.concat_ws("|", "lang", "source")).otherwise(F.concat_ws("|", "lang", "source", F.lit("x")))
    return t("documents").select("doc_id", T.bad_cached_query(q).alias("bad"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("J1_lookup", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    cache = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return M.lookup(t("orders").select("o_orderkey", "o_custkey"), cache, "o_custkey").select("o_orderkey", "c_name")


@query("J2_overlay_filled", "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'q1' ELSE source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    cache = t("labels").select("doc_id", F.when(F.col("quality") == 1, "q1").otherwise("").alias("v"))
    return M.overlay(t("documents").select("doc_id", "source"), cache, "doc_id", "source", "v")


@query("J3_overlay_missing", "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 AND l.doc_id IS NOT NULL THEN 'new' WHEN d.doc_id % 2 = 0 THEN '' ELSE source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    docs = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("source"))
    return M.overlay(docs, t("labels").select("doc_id", F.lit("new").alias("v")), "doc_id", "source", "v", "missing")


@query("J4_overlay_present", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN source WHEN toxic = 1 THEN NULL ELSE 'new' END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    cache = t("labels").select("doc_id", F.when(F.col("toxic") == 0, "new").alias("v"))
    return M.overlay(t("documents").select("doc_id", "source"), cache, "doc_id", "source", "v", "present")


@query("J6_remaining", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def _(t):
    return M.remaining(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("J7_priority_merge", """SELECT id, name, nation, rank AS source_rank FROM (SELECT c_nationkey AS id, 'N' || c_nationkey AS name, c_nationkey AS nation, 0 AS rank FROM customer WHERE c_acctbal > 9000
    UNION ALL SELECT s_nationkey, 'N' || s_nationkey, s_nationkey, 1 FROM supplier) QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, id) = 1""")
def _(t):
    first = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("name"), F.col("c_nationkey").alias("nation"))
    second = t("supplier").select(F.col("s_nationkey").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("name"), F.col("s_nationkey").alias("nation"))
    return M.first_by(M.ranked_union([first, second]), ["name"], "source_rank", "id")


@query("J8_precedence", "SELECT doc_id, arg_min(v, g) AS v FROM (SELECT doc_id, 'label' AS v, 0 AS g FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, lang, 1 FROM documents) GROUP BY doc_id")
def _(t):
    new = t("labels").where("quality = 1").select("doc_id", F.lit("label").alias("v"))
    return M.first_by(M.ranked_union([new, t("documents").select("doc_id", F.col("lang").alias("v"))], "g"), ["doc_id"], "g").drop("g")


@query("J9_key_difference", "SELECT doc_id, 'left' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'right' FROM (SELECT DISTINCT doc_id FROM labels) ANTI JOIN documents USING (doc_id)")
def _(t):
    return M.key_difference(t("documents"), t("labels"), "doc_id")


@query("J10_zero_vectors", "SELECT doc_id AS vec_id, label IS NULL AS missing, CASE WHEN label IS NULL THEN 0.0 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def _(t):
    out = R.with_zero_vectors(t("documents").select(F.col("doc_id").alias("vec_id")), t("embeddings"), "vec_id", "embedding", 64)
    return out.select("vec_id", "missing", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("J11_zip_by_key", "SELECT conv_id, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a USING (conv_id) WHERE u.turn = 0 AND a.turn = 1")
def _(t):
    c = t("conversations")
    return c.where("turn = 0").select("conv_id", F.col("text").alias("question")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("answer")), "conv_id")


@query("J15_common_items", "SELECT doc_id, quality FROM (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) SEMI JOIN documents USING (doc_id)")
def _(t):
    return t("labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).join(t("documents").select("doc_id").distinct(), "doc_id", "left_semi")


@query("J16_grid", "SELECT item_id, f AS domain_filter FROM benchmark, (VALUES ('all'), ('en'), ('de')) v(f)")
def _(t):
    return t("benchmark").select("item_id", F.explode(F.array(*[F.lit(x) for x in ("all", "en", "de")])).alias("domain_filter"))


# --- aggregation ------------------------------------------------------------------------------------------------------


@query("A1_count_with_total", "SELECT lang, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def _(t):
    return t("documents").rollup("lang").agg(F.count(F.lit(1)).alias("n"))


@query("A2_conditional_counts", "SELECT lang, count(*) FILTER (WHERE length(text) < 500) AS short, count(*) FILTER (WHERE contains(text, chr(10))) AS with_lines FROM documents GROUP BY lang")
def _(t):
    return t("documents").groupBy("lang").agg(F.count_if(F.length("text") < 500).alias("short"), F.count_if(F.contains("text", F.lit("\n"))).alias("with_lines"))


@query("A3_value_shares", "SELECT source AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def _(t):
    return E.shares(t("documents"), "source").withColumn("share", six("share"))


@query("A4_counts_with_null", "SELECT quality AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left").groupBy(F.col("quality").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("A5_coverage", "SELECT lang, c AS \"column\", filled, n, round(filled / n, 6) AS share FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE trim(text) NOT IN ('', 'nan', 'None')) AS text, count(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang) UNPIVOT (filled FOR c IN (text, quality))")
def _(t):
    return E.coverage(t("documents").join(t("labels"), "doc_id", "left"), ["text", "quality"], ["lang"]).withColumn("share", six("share"))


@query("A6_failure_rates", "SELECT source, count(*) AS n, sum(toxic)::BIGINT AS failed, round(sum(toxic) / count(*), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(t):
    return E.failure_rates(t("documents").join(t("labels"), "doc_id"), "source", F.col("toxic") == 1).withColumn("rate", six("rate"))


@query("A7_feature_contrast", """WITH m AS (SELECT avg(l_quantity) FILTER (WHERE l_returnflag <> 'R') a1, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') b1, avg(l_discount) FILTER (WHERE l_returnflag <> 'R') a2, avg(l_discount) FILTER (WHERE l_returnflag = 'R') b2 FROM lineitem)
    SELECT 'l_quantity' AS feature, round(a1, 6) AS ok_mean, round(b1, 6) AS failed_mean, round(b1 / a1, 6) AS ratio, abs(b1 / a1 - 1) > 0.25 AS flagged FROM m UNION ALL SELECT 'l_discount', round(a2, 6), round(b2, 6), round(b2 / a2, 6), abs(b2 / a2 - 1) > 0.25 FROM m""")
def _(t):
    out = E.feature_contrast(t("lineitem"), ["l_quantity", "l_discount"], F.col("l_returnflag") == "R")
    return out.withColumns({c: six(c) for c in ("ok_mean", "failed_mean", "ratio")})


GRADED = "SELECT CASE WHEN l_linestatus = 'O' THEN 'new' ELSE 'old' END AS run, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'o' ELSE 'x' END AS grade, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 0.0 END AS value FROM lineitem"


def _graded(t):
    g = F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "o").otherwise("x")
    return t("lineitem").select(F.when(F.col("l_linestatus") == "O", "new").otherwise("old").alias("run"), g.alias("grade"), T.grade_value(g).alias("value"))


@query("A8_mean_pivot", "SELECT lang, round(avg(CASE WHEN quality = 0 THEN n_chars END), 4) AS q0, round(avg(CASE WHEN quality = 1 THEN n_chars END), 4) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(t):
    out = E.pivot_mean(t("documents").join(t("labels"), "doc_id"), ["lang"], "quality", [0, 1], "n_chars")
    return out.select("lang", F.col("0").alias("q0"), F.col("1").alias("q1"))


@query("A9_run_summary", f"SELECT run, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se, round(avg((grade = 'o')::INT), 6) AS rate_o, round(avg((grade = 'a')::INT), 6) AS rate_a, round(avg((grade = 'x')::INT), 6) AS rate_x FROM ({GRADED}) GROUP BY run")
def _(t):
    out = E.run_summary(_graded(t), "run", "value", "grade")
    return out.withColumns({c: six(c) for c in ("mean", "se", "rate_o", "rate_a", "rate_x")})


@query("A10_pivot_by_run", f"SELECT grade, round(avg(CASE WHEN run = 'old' THEN value END), 4) AS old, round(avg(CASE WHEN run = 'new' THEN value END), 4) AS new FROM ({GRADED}) GROUP BY grade")
def _(t):
    return E.pivot_mean(_graded(t), ["grade"], "run", ["old", "new"], "value")


@query("A11_run_difference", f"""WITH g AS ({GRADED}), d AS (SELECT avg(value) FILTER (WHERE run = 'new') - avg(value) FILTER (WHERE run = 'old') AS delta, sqrt(var_samp(value) FILTER (WHERE run = 'new') / count(value) FILTER (WHERE run = 'new') + var_samp(value) FILTER (WHERE run = 'old') / count(value) FILTER (WHERE run = 'old')) AS se FROM g)
    SELECT round(delta, 6) AS delta, round(se, 6) AS se, round(delta / se, 4) AS ratio, CASE WHEN abs(delta / se) >= 2 THEN 'significant' WHEN abs(delta / se) < 1 THEN 'noise' ELSE 'unclear' END AS reading FROM d""")
def _(t):
    out = E.run_difference(_graded(t), "run", "value", "old", "new")
    return out.withColumn("delta", six("delta")).withColumn("se", six("se")).withColumn("ratio", F.round("ratio", 4))


@query("A12_agreement", "SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS exact, round(avg((abs(quality - toxic) <= 1)::INT), 6) AS adjacent FROM labels")
def _(t):
    return E.agreement(t("labels"), "quality", "toxic").withColumn("exact", six("exact")).withColumn("adjacent", six("adjacent"))


HISTORY = "SELECT event_type AS stage, 'val_loss' AS metric, (user_id % 10)::INT AS epoch, event_id AS step, value FROM events"


def _history(t):
    return t("events").select(F.col("event_type").alias("stage"), F.lit("val_loss").alias("metric"), (F.col("user_id") % 10).cast("int").alias("epoch"), F.col("event_id").alias("step"), "value")


@query("A13_epoch_means", f"SELECT stage, metric, epoch, round(avg(value), 6) AS value FROM ({HISTORY}) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY stage, metric, epoch"))
def _(t):
    return E.epoch_means(_history(t)).withColumn("value", six("value"))


@query("A14_shard_merge", "SELECT c_nationkey AS k, arg_min(struct_pack(d := CASE WHEN c_acctbal > 9500 THEN c_name ELSE '' END, t := (c_custkey % 4)::INT), (CASE WHEN c_acctbal > 9500 THEN 0 ELSE 1 END, CASE WHEN c_acctbal > 9500 THEN 0 ELSE -(c_custkey % 4) END, c_custkey)) AS best FROM customer GROUP BY c_nationkey".replace("SELECT c_nationkey AS k, arg_min(", "SELECT k, best.d AS v, best.t AS tries FROM (SELECT c_nationkey AS k, arg_min(").replace("GROUP BY c_nationkey", "GROUP BY c_nationkey)"))
def _(t):
    shards = t("customer").select(F.col("c_nationkey").alias("k"), F.when(F.col("c_acctbal") > 9500, F.col("c_name")).otherwise("").alias("v"), (F.col("c_custkey") % 4).cast("int").alias("tries"), "c_custkey")
    return M.merge_shards(shards, "k", "v", "tries", "c_custkey").select("k", "v", "tries")


@query("A15_cardinality", "SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM part")
def _(t):
    return t("part").agg(F.countDistinct("p_name").alias("names"), F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_type").alias("types"))


@query("A16_duplicates", "SELECT sum(c)::BIGINT AS n, count(*) AS keys, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS in_duplicates, sum(c - 1)::BIGINT AS extra, round(sum(c - 1) / sum(c), 6) AS extra_share FROM (SELECT count(*) AS c FROM documents GROUP BY text)")
def _(t):
    return E.duplicates(t("documents"), "text").withColumn("extra_share", six("extra_share"))


@query("A18_mean_median", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.median("l_extendedprice"), 4).alias("median"))


@query("A19_quartiles", "SELECT round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(quantile_cont(p_retailprice, 0.75), 6) AS q3 FROM part")
def _(t):
    return t("part").agg(six(F.percentile("p_retailprice", F.lit(0.25))).alias("q1"), six(F.percentile("p_retailprice", F.lit(0.75))).alias("q3"))


@query("A20_population_deviation", "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS deviation FROM orders")
def _(t):
    return t("orders").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("deviation"))


def _pairs(t):
    """The stated query set, every vector whose id is divisible by 100, against all vectors."""
    e = t("embeddings")
    return R.scored(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("q_label")), e)


PAIRS = "SELECT q.vec_id AS q, q.label AS q_label, i.vec_id, i.label, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score FROM embeddings i, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"
GOLD = f"SELECT q, count(*) FILTER (WHERE round(score, 9) > own) AS rank FROM (SELECT *, max(CASE WHEN vec_id = (q // 100 * 7 + 3) % 100 THEN round(score, 9) END) OVER (PARTITION BY q) AS own FROM ({PAIRS})) GROUP BY q"


def _gold(t):
    return R.gold_ranks(_pairs(t).withColumn("score", F.round("score", 9)), "q", F.col("vec_id") == (F.floor(F.col("q") / 100) * 7 + 3) % 100)


@query("W2_gold_rank", GOLD)
def _(t):
    return _gold(t)


@query("A21_rank_metrics", f"""SELECT round(avg((rank < 1)::INT), 6) AS recall_1, round(avg((rank < 5)::INT), 6) AS recall_5, round(avg((rank < 10)::INT), 6) AS recall_10, round(avg(CASE WHEN rank < 1 THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg_1,
    round(avg(CASE WHEN rank < 5 THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg_5, round(avg(CASE WHEN rank < 10 THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg_10, round(avg(1 / (rank + 1)), 6) AS mrr, floor(median(rank))::BIGINT + 1 AS median_rank, round(avg(rank) + 1, 6) AS mean_rank, count(*) AS n FROM ({GOLD})""")
def _(t):
    out = R.rank_metrics(_gold(t))
    return out.select(*[six(c).alias(c) if c not in ("median_rank", "n") else F.col(c) for c in out.columns])


@query("A22_centroids", "SELECT label, place, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS place FROM embeddings) GROUP BY label, place")
def _(t):
    return R.centroids(t("embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("place", "m")).select("label", F.col("place").cast("long").alias("place"), F.round("m", 5).alias("mean"))


@query("A23_mean_pool", "SELECT doc_id % 50 AS item, round(coalesce(avg(x), 0), 5) AS first FROM (SELECT DISTINCT doc_id % 50 AS doc_id FROM documents) LEFT JOIN (SELECT vec_id % 100 AS item, embedding[1]::DOUBLE AS x FROM embeddings) ON item = doc_id GROUP BY 1")
def _(t):
    items = t("documents").select((F.col("doc_id") % 50).alias("item")).distinct()
    out = R.pooled(items, t("embeddings").select((F.col("vec_id") % 100).alias("item"), "embedding"), "item", "embedding", 64)
    return out.select("item", F.round(F.col("centroid")[0], 5).alias("first"))


@query("A24_mean_cosines", """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL)
    SELECT a.label AS a, b.label AS b, round(avg(list_cosine_similarity(a.v, b.v)), 4) + 0.0 AS mean_cosine FROM e a JOIN e b ON a.label < b.label OR (a.label = b.label AND a.vec_id <> b.vec_id) GROUP BY 1, 2""")
def _(t):
    return R.mean_cosines(t("embeddings"), "label", "embedding").withColumn("mean_cosine", F.round("mean_cosine", 4) + 0.0)


@query("A25_upper_median", "SELECT list_sort(list(s_acctbal), 'DESC')[len(list(s_acctbal)) // 2 + 1] AS upper_median, count(*) AS n FROM supplier")
def _(t):
    return E.upper_median(t("supplier"), "s_acctbal")


@query("A26_quality_rates", r"SELECT lang, round(avg(contains(text, '|')::INT), 6) AS piped, round(avg(regexp_matches(text, '^\d+\.')::INT), 6) AS numbered, round(avg(regexp_matches(text, '[가-힣]')::INT), 6) AS hangul FROM documents GROUP BY lang")
def _(t):
    rate = lambda c: six(F.avg(c.cast("double")))
    return t("documents").groupBy("lang").agg(rate(F.contains("text", F.lit("|"))).alias("piped"), rate(F.col("text").rlike(r"^\d+\.")).alias("numbered"), rate(F.col("text").rlike("[가-힣]")).alias("hangul"))


@query("A27_cache_counters", "SELECT count(*) FILTER (WHERE quality = 1) AS done, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS given_up FROM labels")
def _(t):
    return t("labels").agg(F.count_if(F.col("quality") == 1).alias("done"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("given_up"))


@query("A28_best_epoch", f"WITH m AS (SELECT stage, epoch, avg(value) AS v FROM ({HISTORY}) GROUP BY stage, epoch) SELECT stage, arg_min(epoch, (v, epoch)) AS best_epoch, round(min(v), 6) AS best_value FROM m GROUP BY stage")
def _(t):
    return E.best_epoch(_history(t)).withColumn("best_value", six("best_value"))


@query("A29_reasons", "SELECT CASE WHEN NOT contains(l, '|') THEN 'no separator' WHEN len(string_split(l, '|')) <> 3 THEN 'parts: ' || len(string_split(l, '|')) ELSE 'unknown' END AS why, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN lang || '|' || source ELSE 'a|b|c' END AS l FROM documents) GROUP BY 1")
def _(t):
    line = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.concat_ws("|", "lang", "source")).otherwise("a|b|c")
    return t("documents").groupBy(T.why_invalid(line).alias("why")).agg(F.count(F.lit(1)).alias("n"))


# --- windows, order, sets ---------------------------------------------------------------------------------------------


@query("T2_topk_per_query", f"SELECT q, vec_id, label, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ({PAIRS})) WHERE rank <= 10")
def _(t):
    out = R.top_k(_pairs(t).withColumn("score", F.round("score", 9)), "q", "vec_id", 10)
    return out.select("q", "vec_id", "label", six("score").alias("score"), "rank")


@query("W1_rank_in_filter", f"SELECT q, label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ({PAIRS})) WHERE rank <= 3")
def _(t):
    pairs = _pairs(t).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("q", "label").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("q", "label", "vec_id", "rank")


@query("T1_topk_all_domains", f"SELECT vec_id, label, round(score, 6) AS score FROM ({PAIRS}) WHERE q = 0 ORDER BY round(score, 9) DESC, label, vec_id LIMIT 10")
def _(t):
    items = t("embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("domain"), "embedding")
    one = items.where("item_id = 0").select(F.col("embedding").alias("qv"))
    pairs = R.scored(one, items).withColumn("score", F.round("score", 9))
    return pairs.orderBy(F.desc("score"), "domain", "item_id").limit(10).select(F.col("item_id").alias("vec_id"), F.col("domain").alias("label"), six("score").alias("score"))


@query("W3_dedup_by_information", "SELECT arg_min(doc_id, (-(CASE WHEN quality IS NULL THEN 0 ELSE 1 END), doc_id)) AS doc_id, text FROM documents LEFT JOIN labels USING (doc_id) GROUP BY text")
def _(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "text", F.col("quality").cast("string").alias("quality"))
    return M.drop_duplicates_by_information(rows, "text", ["quality"], "doc_id").select("doc_id", "text")


@query("W6_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN NULL ELSE value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events")
def _(t):
    rows = t("events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return X.forward_fill(rows, "value", "event_id", ["user_id"]).select("event_id", "value")


@query("W7_early_stopping", """WITH a AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    b AS (SELECT *, (n - max(CASE WHEN before IS NULL OR value < before THEN n END) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS misses FROM a) SELECT user_id, event_id, best, misses, max(misses >= 3) OVER (PARTITION BY user_id ORDER BY event_id) AS stopped FROM b""")
def _(t):
    return E.early_stopping(t("events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "best", "misses", "stopped")


@query("W8_previous_delta", "SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def _(t):
    return t("events").select("user_id", "event_id", six(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("delta"))


@query("W9_head_per_stratum", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def _(t):
    w = Window.partitionBy("source").orderBy("doc_id")
    return t("documents").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "doc_id")


@query("W10_shard", "SELECT doc_id FROM documents WHERE doc_id % 8 = 3")
def _(t):
    return M.sharded(t("documents"), F.col("doc_id"), 3, 8).select("doc_id")


@query("W11_chunks", "SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16)::BIGINT AS chunk FROM documents")
def _(t):
    return M.chunked(t("documents").select("source", "doc_id"), "doc_id", 16, ["source"])


@query("W12_rotation", "SELECT r_regionkey, array_to_string(list_concat(l[(r_regionkey % 5) + 1:], l[:r_regionkey % 5]), ',') AS items FROM (SELECT r_regionkey, list_sort(list(n_name)) AS l FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey)")
def _(t):
    lists = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return lists.select("r_regionkey", F.array_join(M.rotated(F.col("l"), F.col("r_regionkey")), ",").alias("items"))


@query("T5_most_common", "SELECT source AS value, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source ORDER BY n DESC, first LIMIT 5")
def _(t):
    return t("documents").groupBy(F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).orderBy(F.desc("n"), "first").limit(5)


@query("U1_union_all", "SELECT c_name AS name, c_acctbal AS balance, 0 AS source_rank FROM customer UNION ALL SELECT s_name, s_acctbal, 1 FROM supplier")
def _(t):
    return M.ranked_union([t("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("U2_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).subtract(t("supplier").select("s_nationkey"))


WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9'']+'))"
TURNS = "SELECT q.conv_id, q.turn, q.text AS q, a.text AS a FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1"


def _turns(t):
    c = t("conversations")
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return c.select("conv_id", "turn", F.col("text").alias("q")).join(a, ["conv_id", "turn"])


@query("U3_jaccard", f"SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) > 0 THEN len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0 END, 6) AS jaccard FROM (SELECT conv_id, turn, {WORDS.format('q')} AS x, {WORDS.format('a')} AS y FROM ({TURNS}))")
def _(t):
    x, y = (F.array_distinct(T.words(F.col(c))) for c in "qa")
    return _turns(t).select("conv_id", "turn", six(T.jaccard(x, y)).alias("jaccard"))


@query("U4_distinct_in_order", "SELECT text, min(doc_id) AS first_place FROM documents GROUP BY text")
def _(t):
    return M.distinct_in_order(t("documents"), "text", "doc_id")


@query("U5_toggle", "SELECT conv_id, array_to_string(CASE WHEN list_contains(l, 1) THEN list_filter(l, lambda x: x <> 1) ELSE list_append(l, 1) END, ',') AS saved FROM (SELECT conv_id, list_sort(list(turn)) AS l FROM conversations GROUP BY conv_id)")
def _(t):
    lists = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("l"))
    return lists.select("conv_id", F.array_join(M.toggled(F.col("l"), F.lit(1).cast("long")).cast("array<string>"), ",").alias("saved"))


# --- text functions ---------------------------------------------------------------------------------------------------

TITLE = "p_name || ' (' || p_brand || '): ' || p_type"


def _title():
    return F.concat("p_name", F.lit(" ("), "p_brand", F.lit("): "), "p_type")


@query("C1_title_key", rf"SELECT p_partkey, trim(regexp_replace(regexp_replace(split_part(regexp_replace(lower({TITLE}), '\([^)]*\)', ' ', 'g'), ':', 1), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM part")
def _(t):
    return t("part").select("p_partkey", T.title_key(_title()).alias("k"))


@query("C2_author_key", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(split_part(p_name || ', J.K. ' || p_type, '(', 1)), '[^a-z]+'), lambda w: length(w) > 1))), ' ') AS k FROM part")
def _(t):
    return t("part").select("p_partkey", T.author_key(F.concat("p_name", F.lit(", J.K. "), "p_type")).alias("k"))


@query("C3_item_key", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) || '|' || lower(c_mktsegment) AS k FROM customer")
def _(t):
    return t("customer").select("c_custkey", T.item_key(F.col("c_name"), F.col("c_mktsegment")).alias("k"))


@query("C4_strip_roles", "SELECT p_partkey, p_name || ', ' || p_type AS author FROM part")
def _(t):
    return t("part").select("p_partkey", T.strip_roles(F.concat("p_name", F.lit(" (Illustrator) ,"), "p_type", F.lit(" (Goodreads Author)"))).alias("author"))


@query("C5_tidy_punctuation", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\s*,\s*', '\1 ', 'g'), '\s+,', ',', 'g'), '[ \t]+', ' ', 'g')) AS tidy FROM documents")
def _(t):
    return t("documents").select("doc_id", T.tidy_punctuation(F.col("text")).alias("tidy"))


@query("C6_isbn", "SELECT p_partkey, CASE WHEN regexp_matches(x, '^(\\d{9}[\\dX]|\\d{13})$') AND x NOT IN ('9999999999', '9999999999999') THEN x ELSE '' END AS isbn FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lpad(p_partkey::VARCHAR, 9, '0') || 'X' WHEN 1 THEN lpad(p_partkey::VARCHAR, 13, '9') WHEN 2 THEN p_name ELSE '9999999999' END AS x FROM part)")
def _(t):
    key = F.col("p_partkey").cast("string")
    x = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lpad(key, 9, "0"), F.lit("x"))).when(F.col("p_partkey") % 4 == 1, F.lpad(key, 13, "9")).when(F.col("p_partkey") % 4 == 2, F.col("p_name")).otherwise("9999999999")
    return t("part").select("p_partkey", T.isbn(x).alias("isbn"))


@query("C11_json_list", "SELECT p_partkey, '[\"' || replace(p_name, ' ', '\", \"') || '\"]' AS j FROM part")
def _(t):
    return t("part").select("p_partkey", T.json_list(F.replace("p_name", F.lit(" "), F.lit(" | "))).alias("j"))


@query("C12_strip_year", "SELECT p_partkey, p_name AS title FROM part")
def _(t):
    return t("part").select("p_partkey", T.strip_year(F.concat("p_name", F.lit(" (1995) "))).alias("title"))


@query("C13_category", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Horror' WHEN 1 THEN 'Comics/Graphic Novels' WHEN 2 THEN 'Short Stories' WHEN 3 THEN 'Science Fiction' ELSE 'Other' END AS category FROM part")
def _(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" Vampires ", "Comic strips", "Short stories, English", "American science fiction tales", "xyz")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t("part").select("p_partkey", C.category(raw).alias("category"))


@query("C14_main_category", "SELECT p_partkey, p_type AS main FROM part")
def _(t):
    return t("part").select("p_partkey", T.main_category(F.concat(F.lit(" "), "p_type", F.lit(" , "), "p_brand")).alias("main"))


@query("C15_padded_id", "SELECT o_orderkey, CASE WHEN length(o_orderkey::VARCHAR) < 4 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END AS id FROM orders")
def _(t):
    return t("orders").select("o_orderkey", T.padded_id(F.col("o_orderkey").cast("string"), 4).alias("id"))


@query("C16_content_text", "SELECT doc_id, 'Title: ' || source || chr(10) || 'Description: ' || substring(trim(substring(text, 1, 600)), 1, 600) AS content FROM documents")
def _(t):
    return t("documents").select("doc_id", T.content_text(Title=F.col("source"), Description=F.col("text"), Genre=F.lit("nan")).alias("content"))


@query("C17_first_parts", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang || '|' || source || '|c' END AS parts FROM documents")
def _(t):
    line = F.concat_ws("|", F.col("lang"), F.col("source"), F.lit(" c "), F.lit("d"))
    raw = F.when(F.col("doc_id") % 3 == 0, "[Output]\na|b").otherwise(F.concat(F.lit("[Output]\n\n"), line))
    return t("documents").select("doc_id", T.first_parts(raw).alias("parts"))


@query("C18_exact_parts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '|a|b|c' END AS parts FROM documents")
def _(t):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("lang"), F.lit("|a|b|c"))).otherwise("a|b|c")
    return t("documents").select("doc_id", T.first_parts(raw, 4, exact=True).alias("parts"))


@query("C20_list_of_queries", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''), '/') AS parts FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(T.split_list(F.concat(F.lit("| "), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit(" |"))), "/").alias("parts"))


@query("C22_content_words", f"SELECT doc_id, len(list_filter({WORDS.format('text')}, lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in T.STOPWORDS)}], w))) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(T.content_words(F.col("text"))).cast("long").alias("n"))


@query("C23_shingles", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END::BIGINT AS n FROM w")
def _(t):
    return t("documents").select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n"))


@query("C24_strip_titles", "SELECT p_partkey, '  is ' || p_type || ' here' AS bare FROM part")
def _(t):
    text = F.concat(F.lit('"a quote"'), F.lit(" is "), "p_type", F.lit(" here"))
    return t("part").select("p_partkey", T.strip_titles(text, F.lit("nan")).alias("bare"))


@query("C25_rule_rates", "SELECT doc_id, regexp_matches(text, '(?i)\\b(released|release date|published in|publication|first aired)\\b') AS release_info, regexp_matches(text, '[\"“][^\"”]{25,}[\"”]') AS review_quote FROM documents")
def _(t):
    return t("documents").select("doc_id", *[F.col("text").rlike(T.RULES[k]).alias(k) for k in ("release_info", "review_quote")])


@query("C26_sentences", r"SELECT doc_id, len(regexp_extract_all(text, '[.!?](?:\s|$)'))::BIGINT AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", T.sentences(F.col("text")).cast("long").alias("n"))


@query("C27_overlap", f"SELECT conv_id, turn, round(CASE WHEN len(x) > 0 THEN len(list_intersect(x, y)) / len(x) END, 6) AS overlap FROM (SELECT conv_id, turn, {WORDS.format('q')} AS x, {WORDS.format('a')} AS y FROM ({TURNS}))")
def _(t):
    x, y = (F.array_distinct(T.words(F.col(c))) for c in "qa")
    return _turns(t).select("conv_id", "turn", six(T.overlap(x, y)).alias("overlap"))


@query("C28_title_kept", f"SELECT conv_id, turn, list_has_any(list_filter({WORDS.format('q')}, lambda w: length(w) >= 4), {WORDS.format('a')}) AS kept FROM ({TURNS})")
def _(t):
    return _turns(t).select("conv_id", "turn", T.title_kept(F.col("q"), F.col("a")).alias("kept"))


@query("C29_stratum", "SELECT doc_id, lang || '/' || source AS stratum FROM documents")
def _(t):
    return t("documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("stratum"))


@query("C30_non_ascii", r"SELECT doc_id, round(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / greatest(length(text), 1), 6) AS share FROM documents")
def _(t):
    return t("documents").select("doc_id", six(T.non_ascii_share(F.col("text"))).alias("share"))


@query("C31_plot_and_keywords", "SELECT p_partkey, p_name || ' ' || p_type AS plot, 'a, b, ' || p_brand AS keywords FROM part")
def _(t):
    x = F.concat_ws(" | ", "p_name", "p_type", F.concat(F.lit("a, b, "), "p_brand"))
    return t("part").select("p_partkey", T.plot_and_keywords(x).alias("s")).select("p_partkey", "s.*")


@query("C33_prompt", "SELECT p_partkey, '[Task]' || chr(10) || 'Describe the item.' || chr(10) || chr(10) || '[Item]' || chr(10) || 'Name: ' || p_name || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || '[Type]' || chr(10) || p_type ELSE '' END AS prompt FROM part")
def _(t):
    return t("part").select("p_partkey", T.prompt("Describe the item.", T.labelled(Name=F.col("p_name")), Type=F.when(F.col("p_size") > 25, F.col("p_type"))).alias("prompt"))


@query("C34_provenance", "SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice > 950 THEN 'size+price' WHEN p_size > 25 THEN 'size' WHEN p_retailprice > 950 THEN 'price' ELSE 'meta_only' END AS basis FROM part")
def _(t):
    return t("part").select("p_partkey", T.provenance(size=F.col("p_size") > 25, price=F.col("p_retailprice") > 950).alias("basis"))


@query("C35_grade", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'o' WHEN 1 THEN 'a' WHEN 2 THEN 'x' END AS grade, CASE doc_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END::DOUBLE AS value FROM documents")
def _(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Grade: O", "a.", "(x) o", "none")]), (F.col("doc_id") % 4 + 1).cast("int"))
    g = T.grade(raw)
    return t("documents").select("doc_id", g.alias("grade"), T.grade_value(g).alias("value"))


@query("C36_judge_key", "SELECT conv_id, turn, role || '|' || conv_id || '|' || turn AS judge_key FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", F.concat_ws("|", "role", "conv_id", "turn").alias("judge_key"))


@query("C38_host", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def _(t):
    return t("pages").select("page_id", T.host(F.col("url")).alias("host"))


@query("C40_routed", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'movie' END AS domain, p_name AS query FROM part")
def _(t):
    line = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Movie:  ").otherwise(""), F.col("p_name"))
    return t("part").select("p_partkey", T.routed(line).alias("r")).select("p_partkey", "r.*")


@query("C41_cut_middle", r"SELECT doc_id, CASE WHEN len(w) <= 20 THEN text ELSE array_to_string(w[1:12], ' ') || ' ... ' || array_to_string(w[len(w) - 7:], ' ') END AS cut FROM (SELECT doc_id, text, regexp_split_to_array(trim(text), '\s+') AS w FROM documents)")
def _(t):
    return t("documents").select("doc_id", T.cut_middle(F.col("text"), 20).alias("cut"))


@query("C42_shown", "SELECT p_partkey, 'brand: ' || p_brand || ' | type: ' || p_type AS shown FROM part")
def _(t):
    extra = F.create_map(F.lit("type"), F.col("p_type"), F.lit("none"), F.lit(""), F.lit("brand"), F.col("p_brand"))
    return t("part").select("p_partkey", T.shown(extra).alias("shown"))


@query("C9_clean_description", "SELECT p_partkey, p_name AS blurb FROM part")
def _(t):
    stacked = F.repeat(F.lit("Over 1,000 copies sold! "), F.pmod("p_partkey", F.lit(9)).cast("int"))
    raw = F.concat(F.lit("#1 New York Times bestseller. "), stacked, F.lit("Don't miss the next one, available now. "), F.col("p_name"))
    return t("part").select("p_partkey", T.clean_description(raw).alias("blurb"))


@query("C10_strip_wrapping", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '.' ELSE '\"' || p_name || '\" and \"' || p_type || '\"' END AS text FROM part")
def _(t):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), F.col("p_name"), F.lit('."'))).otherwise(F.concat(F.lit('"'), F.col("p_name"), F.lit('" and "'), F.col("p_type"), F.lit('"')))
    return t("part").select("p_partkey", T.strip_wrapping(raw).alias("text"))


@query("C7_genre_list", "SELECT p_partkey, p_brand || ', ' || p_type AS genres FROM part")
def _(t):
    raw = F.concat(F.lit("['"), "p_brand", F.lit("', \""), "p_type", F.lit('"]'))
    return t("part").select("p_partkey", T.genre_list(raw).alias("genres"))


# --- numbers and vectors ----------------------------------------------------------------------------------------------


@query("N1_short_year", "SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y FROM orders")
def _(t):
    return t("orders").select("o_orderkey", N.short_year(F.date_format("o_orderdate", "MM/dd/yy")).alias("y"))


@query("N2_year_between", "SELECT p_partkey, CASE WHEN p_size * 50 BETWEEN 1400 AND 2100 THEN (p_size * 50)::VARCHAR ELSE '' END AS y FROM part")
def _(t):
    return t("part").select("p_partkey", N.year_between(F.concat((F.col("p_size") * 50).cast("string"), F.lit(".0"))).alias("y"))


@query("N3_year_of", "SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y FROM orders")
def _(t):
    return t("orders").select("o_orderkey", N.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("y"))


@query("N4_first_of_year", "SELECT o_orderkey, year(o_orderdate)::VARCHAR || '-01-01' AS d FROM orders")
def _(t):
    return t("orders").select("o_orderkey", N.first_of_year(F.year("o_orderdate").cast("double").cast("string")).alias("d"))


@query("N5_whole", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", N.whole(F.col("l_quantity").cast("string")).alias("q"))


@query("N6_popularity", "SELECT p_partkey, p_size + 10 * (p_partkey % 7) AS popularity FROM part")
def _(t):
    return t("part").select("p_partkey", N.popularity(F.lit(None).cast("long"), F.col("p_size").cast("long"), F.col("p_partkey") % 7).alias("popularity"))


@query("N7_audio_phrases", """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN e < 0.4 THEN 'calm and mellow' WHEN e >= 0.7 THEN 'high-energy and intense' ELSE 'moderately energetic' END, CASE WHEN v < 0.35 THEN 'melancholic and somber' WHEN v >= 0.65 THEN 'upbeat and positive' ELSE 'emotionally balanced' END,
    CASE WHEN l_linenumber = 1 THEN 'major key (brighter)' WHEN l_linenumber = 0 THEN 'minor key (darker)' END], lambda x: x IS NOT NULL), ', ') AS phrases FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS e, l_discount * 10 AS v FROM lineitem)""")
def _(t):
    none = F.lit(-1.0)
    p = N.audio_phrases(F.col("l_quantity") / 50, none, F.col("l_discount") * 10, none, none, none, none, none, F.col("l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", p.alias("phrases"))


@query("N8_standard_scaler", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS scaled FROM part")
def _(t):
    return X.Scaler.fit(t("part"), ["p_retailprice"]).transform(t("part")).select("p_partkey", six("p_retailprice").alias("scaled"))


@query("N8_minmax_scaler", "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS scaled FROM part")
def _(t):
    return X.Scaler.fit(t("part"), ["p_size"], "minmax").transform(t("part")).select("p_partkey", six("p_size").alias("scaled"))


@query("N9_label_codes", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand)::INT - 1 AS code FROM part")
def _(t):
    return X.encode_labels(t("part"), "p_brand", "code").select("p_partkey", "code")


@query("N10_fill_median", "SELECT event_id, coalesce(x, median(x) OVER ()) AS value FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS x FROM events)")
def _(t):
    rows = t("events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return X.fill_missing(rows, ["value"], "median")


@query("N11_quartile_inliers", "SELECT o_orderkey, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inlier FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)")
def _(t):
    return X.inside_quartiles(t("orders"), ["o_totalprice"]).select("o_orderkey", "inlier")


@query("N12_deviation_inliers", "SELECT event_id, abs((value - m) / (s + 1e-8)) < 2 AS inlier FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def _(t):
    return X.inside_deviations(t("events"), ["value"], 2.0).select("event_id", "inlier")


@query("N13_isolation")
def _(t):
    return X.isolation_scores(t("part"), ["p_retailprice", "p_size"]).select("p_partkey", six("isolation").alias("isolation"))


@query("N14_similarities", """SELECT q, vec_id, round(score, 6) AS cosine, round(1 / (1 + list_distance(a, b)), 6) AS euclidean FROM (SELECT q.vec_id AS q, i.vec_id, q.embedding::DOUBLE[] AS a, i.embedding::DOUBLE[] AS b, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score FROM embeddings i, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)""")
def _(t):
    return _pairs(t).select("q", "vec_id", six("score").alias("cosine"), six(N.euclidean_similarity(F.col("qv"), F.col("embedding"))).alias("euclidean"))


@query("N15_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 5) AS total FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.round(F.aggregate(N.unit(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("N16_centred", """WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding)))::INT AS place FROM embeddings), c AS (SELECT label, place, avg(x) AS m FROM e GROUP BY label, place),
    d AS (SELECT vec_id, e.label, e.place, x - m AS x FROM e JOIN c ON e.label = c.label AND e.place = c.place)
    SELECT vec_id, label, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 5) + 0.0 AS x FROM d""")
def _(t):
    return R.centred(t("embeddings"), "label", "embedding").select("vec_id", "label", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.round("x", 5) + F.lit(0.0))


@query("N18_info_nce", f"""WITH p AS (SELECT 0 AS batch, q, vec_id AS i, score / 0.07 AS l FROM ({PAIRS}) WHERE vec_id % 100 = 0),
    a AS (SELECT q, max(l) + ln(sum(exp(l - 100))) - max(l) + 100 - max(CASE WHEN q = i THEN l END) AS x FROM p GROUP BY q), b AS (SELECT i, ln(sum(exp(l - 100))) + 100 - max(CASE WHEN q = i THEN l END) AS x FROM p GROUP BY i)
    SELECT 0 AS batch, round(((SELECT avg(x) FROM a) + (SELECT avg(x) FROM b)) / 2, 5) AS loss""")
def _(t):
    pairs = _pairs(t).where("vec_id % 100 = 0").withColumn("batch", F.lit(0))
    return R.info_nce(pairs, "batch", "q", "vec_id", "score").withColumn("loss", F.round("loss", 5))


@query("N20_minhash")
def _(t):
    return t("documents").select("doc_id", F.array_join(D.signature(T.shingles(F.col("text"))).cast("array<string>"), ",").alias("signature"))


@query("N22_near_copies_lsh")
def _(t):
    return D.near_copies(t("documents"), "doc_id", "text").withColumn("jaccard", six("jaccard"))


@query("N22_near_copies_exact", """WITH w AS (SELECT min(doc_id) AS id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents GROUP BY text),
    s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
    g AS (SELECT id, unnest(s) AS g FROM s), n AS (SELECT id, len(s) AS n FROM s), c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k / (x.n + y.n - k) >= 0.8""")
def _(t):
    return D.exact_jaccard_pairs(t("documents"), "doc_id", "text", 0.8).withColumn("jaccard", six("jaccard"))


@query("N23_image_tokens", "SELECT p_partkey, (greatest(28, round_even(w * s / 28, 0) * 28) * greatest(28, round_even(h * s / 28, 0) * 28) / 784)::BIGINT AS tokens FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 30 AS h, least(1.0, sqrt(1003520.0 / (p_size * 40 * p_size * 30))) AS s FROM part)")
def _(t):
    return t("part").select("p_partkey", N.image_tokens(F.col("p_size") * 40, F.col("p_size") * 30).alias("tokens"))


@query("N24_from_json_list", "SELECT p_partkey, replace(p_name, ' ', ', ') AS items FROM part")
def _(t):
    return t("part").select("p_partkey", T.from_json_list(T.json_list(F.col("p_name"), " ")).alias("items"))


@query("N26_failure_bins", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.001 THEN '[0,0.001)' WHEN l_tax < 0.2 THEN '[0.001,0.2)' WHEN l_tax < 0.5 THEN '[0.2,0.5)' ELSE '[0.5,1.01)' END AS bin FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", N.failure_bin(F.col("l_tax")).alias("bin"))


# --- sampling and splitting -------------------------------------------------------------------------------------------


@query("R1_split_sizes", "SELECT part, n FROM (SELECT 'test' AS part, count(*) * 2 // 10 AS n FROM documents UNION ALL SELECT 'val', (count(*) - count(*) * 2 // 10) // 10 FROM documents UNION ALL SELECT 'train', count(*) - count(*) * 2 // 10 - (count(*) - count(*) * 2 // 10) // 10 FROM documents)")
def _(t):
    return X.split(t("documents").select("doc_id"), "doc_id", 0.2, 0.1).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("R3_undersample_sizes", "SELECT lang, (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) AS n FROM documents GROUP BY lang")
def _(t):
    return X.balanced(t("documents").select("lang", "doc_id"), "lang", "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("R3_oversample_sizes", "SELECT lang, (SELECT max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) AS n FROM documents GROUP BY lang")
def _(t):
    return X.balanced(t("documents").select("lang", "doc_id"), "lang", "doc_id", over=True).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("R4_smote_sizes", "SELECT lang, m - count(*) AS n FROM documents, (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) GROUP BY lang, m HAVING m > count(*)")
def _(t):
    rows = t("documents").select("lang", "doc_id", "n_chars", F.length("source").alias("s"))
    return X.smote(rows, "lang", "doc_id", ["n_chars", "s"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("R5_stratified_sizes", "SELECT source, least(count(*), 10) AS n FROM documents GROUP BY source")
def _(t):
    return X.stratified(t("documents").select("source", "doc_id"), "source", "doc_id", 10).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("R6_allocation", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), a AS (SELECT lang, n, round_even(n * 100.0 / (SELECT sum(n) FROM c), 0)::BIGINT AS alloc FROM c) SELECT lang, n, alloc + CASE WHEN lang = (SELECT arg_max(lang, (n, lang)) FROM c) THEN 100 - (SELECT sum(alloc) FROM a) ELSE 0 END::BIGINT AS alloc FROM a")
def _(t):
    return X.proportional_allocation(t("documents"), "lang", 100)


@query("R9_work_queue", "SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic >= 1) USING (doc_id)")
def _(t):
    cache = t("labels").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("").alias("v"), F.col("toxic").alias("tries"))
    return M.work_queue(t("documents").select("doc_id"), cache, "doc_id", "v", "tries", 1)


@query("M11_collate", "SELECT source, chunk, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32)::BIGINT AS chunk FROM documents) GROUP BY source, chunk")
def _(t):
    rows = M.chunked(t("documents").select("source", "doc_id"), "doc_id", 32, ["source"])
    return rows.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("M15_item_lookup", "SELECT p_partkey, p_name AS title, p_brand AS brand FROM part WHERE p_partkey = 7")
def _(t):
    return t("part").where("p_partkey = 7").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))


# --- further operators ------------------------------------------------------------------------------------------------


@query("J5_positional_update", "SELECT doc_id, CASE WHEN rn % 10 = 0 THEN 'checked' ELSE lang END AS lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)")
def _(t):
    rows = X.numbered(t("documents").select("doc_id", "lang"), F.col("doc_id"))
    update = rows.where("place % 10 = 0").select("place", F.lit("checked").alias("v"))
    return M.overlay(rows, update, "place", "lang", "v").select("doc_id", "lang")


@query("J12_query_item_scores", f"SELECT q, count(*) AS n, round(avg(score), 5) AS mean, round(max(score), 6) AS best FROM ({PAIRS}) GROUP BY q")
def _(t):
    return _pairs(t).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean"), six(F.max("score")).alias("best"))


@query("J13_bucket_pairs", "SELECT text, first AS a, doc_id AS b FROM (SELECT text, doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id > first")
def _(t):
    """Equal texts: the first of each bucket with every other member, which is whole and grows with the members alone."""
    d = t("documents").where("text IS NOT NULL").select("text", F.col("doc_id").alias("b"))
    first = d.groupBy("text").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return d.join(first, "text").where("b > a").select("text", "a", "b")


@query("J14_in_batch_pairs", "SELECT u.label AS label, count(*) AS n FROM embeddings u JOIN embeddings v ON u.label = v.label AND u.vec_id // 64 = v.vec_id // 64 GROUP BY u.label")
def _(t):
    e = t("embeddings").select("label", "vec_id", F.floor(F.col("vec_id") / 64).alias("batch"))
    return e.join(e.select("label", "batch", F.col("vec_id").alias("other")), ["label", "batch"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("A17_exact_duplicate_rate", "SELECT lang, round((count(*) - count(DISTINCT text)) / count(*), 6) AS rate FROM documents GROUP BY lang")
def _(t):
    return t("documents").groupBy("lang").agg(six((F.count(F.lit(1)) - F.countDistinct("text")) / F.count(F.lit(1))).alias("rate"))


@query("W4_keep_first", "SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang")
def _(t):
    return M.first_by(t("documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")


@query("W5_bucket_heads", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 200")
def _(t):
    w = Window.partitionBy("source").orderBy("doc_id")
    return t("documents").withColumn("r", F.row_number().over(w)).where("r <= 200").select("source", "doc_id")


@query("W13_first_of_repeated_index", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id")
def _(t):
    return M.first_by(t("conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn").select("conv_id", "text")


@query("T3_stable_order_by_information", "SELECT doc_id, row_number() OVER (ORDER BY quality IS NULL, doc_id) - 1 AS place FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.col("quality").isNull().cast("int").alias("empty"))
    return X.numbered(rows, F.col("empty") * F.lit(2.0**50) + F.col("doc_id"), F.col("doc_id")).select("doc_id", "place")


@query("T4_worst_first", "SELECT source, round(avg(toxic), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source ORDER BY rate DESC, source LIMIT 7")
def _(t):
    out = E.failure_rates(t("documents").join(t("labels"), "doc_id"), "source", F.col("toxic") == 1)
    return out.select("source", six("rate").alias("rate")).orderBy(F.desc_nulls_last("rate"), "source").limit(7)


@query("T6_seeded_sample_size", "SELECT least(count(*), 100) AS n FROM documents")
def _(t):
    return t("documents").orderBy(X.shuffled_place(F.col("doc_id"), 42), "doc_id").limit(100).agg(F.count(F.lit(1)).alias("n"))


@query("T7_k_over_n", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return t("nation").orderBy("n_nationkey").limit(1000).select("n_nationkey", "n_name")


@query("R2_split_ceiling", "SELECT part, n FROM (SELECT 'test' AS part, ceil(count(*) * 0.15)::BIGINT AS n FROM documents UNION ALL SELECT 'train', count(*) - ceil(count(*) * 0.15)::BIGINT FROM documents)")
def _(t):
    return X.split(t("documents").select("doc_id"), "doc_id", 0.15, up=True).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("R7_one_query_per_epoch", "SELECT doc_id, true AS in_list FROM documents")
def _(t):
    values = F.array("lang", "source")
    pick = X.one_of(values, F.col("doc_id"), 3)
    return t("documents").select("doc_id", F.array_contains(values, pick).alias("in_list"))


@query("R8_shards_cover", "SELECT doc_id % 4 AS shard, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    parts = [M.sharded(t("documents"), F.col("doc_id"), k, 4).select(F.lit(k).cast("long").alias("shard")) for k in range(4)]
    return M.ranked_union(parts, "r").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("C8_cover_url", "SELECT p_partkey, 'https://covers.openlibrary.org/b/isbn/' || lpad(p_partkey::VARCHAR, 13, '1') || '-L.jpg' AS url FROM part")
def _(t):
    return t("part").select("p_partkey", T.cover_url(T.isbn(F.lpad(F.col("p_partkey").cast("string"), 13, "1"))).alias("url"))


@query("C19_why_invalid", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'empty output' WHEN 1 THEN 'labels only' WHEN 2 THEN 'empty part' ELSE 'parts: 4' END AS why FROM documents")
def _(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" \n", "[Output]\n[x]", "[Output]\na||c", "a|b|c|d")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", T.why_invalid(raw).alias("why"))


@query("C21_title_dropout", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Type: ' || p_type ELSE 'Title: ' || p_name || chr(10) || 'Type: ' || p_type END AS content FROM part")
def _(t):
    content = T.labelled(Title=F.col("p_name"), Type=F.col("p_type"))
    return t("part").select("p_partkey", T.keep_label_lines(content, F.col("p_partkey") % 3 == 0).alias("content"))


@query("C32_labelled_lines", "SELECT doc_id, 'Lang: ' || lang || CASE WHEN quality IS NOT NULL THEN chr(10) || 'Quality: ' || quality ELSE '' END AS lines FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    j = t("documents").join(t("labels"), "doc_id", "left")
    return j.select("doc_id", T.labelled(Lang=F.col("lang"), Quality=F.col("quality").cast("string")).alias("lines"))


@query("C37_strip_links", "SELECT p_partkey, p_name || ' ends' AS text FROM part")
def _(t):
    raw = F.concat(F.lit(" "), "p_name", F.lit(' <a href="http://x">Read\nmore</a>  ends '))
    return t("part").select("p_partkey", T.strip_links(raw).alias("text"))


@query("C39_first_artist", "SELECT p_partkey, split_part(p_name, ' ', 1) AS artist FROM part")
def _(t):
    return t("part").select("p_partkey", T.first_of_json_list(T.json_list(F.col("p_name"), " ")).alias("artist"))


@query("C43_element_text", r"""SELECT page_id, CASE WHEN length(x) > 50 THEN substring(x, 1, 3000) END AS text FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_extract(html, '(?is)<footer\b[^>]*>(.*?)(?:</footer\s*>|\z)', 1), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS x FROM pages)""")
def _(t):
    from ..functions.html import element_text

    return t("pages").select("page_id", element_text(F.col("html"), "footer").alias("text"))


@query("N17_dot", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b")
def _(t):
    e = t("embeddings")
    one = e.where("vec_id = 1").select(F.col("embedding").alias("b"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(N.dot(F.col("embedding"), F.col("b")), 5).alias("score"))


@query("N19_batch_kl", "SELECT label, round(sum(k) / count(*), 5) AS loss FROM (SELECT label, vec_id, list_sum(list_transform(range(1, 65), lambda i: exp(embedding[i]::DOUBLE) * (embedding[i]::DOUBLE - embedding[65 - i]::DOUBLE))) AS k FROM embeddings) GROUP BY label")
def _(t):
    e = t("embeddings").select("label", F.col("embedding").cast("array<double>").alias("target"))
    return R.batch_kl(e.withColumn("p", F.reverse("target")), "label", "p", "target").withColumn("loss", F.round("loss", 5))


@query("N25_extra_map", "SELECT p_partkey, 'brand=' || p_brand || CASE WHEN p_size > 25 THEN ',size=' || p_size ELSE '' END AS extra FROM part")
def _(t):
    from .flows import meta

    rows = t("part").withColumn("big", F.when(F.col("p_size") > 25, F.col("p_size")))
    m = meta(rows, "p_partkey", "book", "p_name", {"brand": "p_brand", "size": "big", "gone": "no_such_column"})
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return m.select(F.col("item_id").cast("long").alias("p_partkey"), shown.alias("extra"))


@query("N27_year_prefix", "SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), 1, 4).try_cast("int").alias("y"))


@query("M10_counts_by_block", "SELECT split_part(p_name, ' ', 2) AS block, sum(p_size)::BIGINT AS parameters FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("block")).agg(F.sum("p_size").alias("parameters"))


@query("F12_image_path", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'images/' || p_partkey || '.jpg' WHEN p_partkey % 3 = 1 THEN 'http://x/' || p_partkey ELSE '' END AS image_path FROM part")
def _(t):
    from .flows import Domain, standard_items

    key = F.col("p_partkey").cast("string")
    rows = t("part").withColumn("img", F.when(F.col("p_partkey") % 3 == 2, "no").otherwise(F.concat(F.lit("http://x/"), key)))
    files = t("part").where("p_partkey % 3 = 0").select(key.alias("item_id"), F.concat(F.lit("images/"), key, F.lit(".jpg")).alias("path"))
    out = standard_items(rows, Domain("book", "p_partkey", {"Title": "p_name"}, ("p_type",), "img"), files=files)
    return out.select(F.col("item_id").cast("long").alias("p_partkey"), "image_path")


@query("L3_standard_items", "SELECT doc_id::VARCHAR AS item_id, 'Title: ' || source || chr(10) || 'Description: ' || trim(substring(text, 1, 600)) AS content_text, '' AS image_path, CASE WHEN quality = 1 THEN 'good' END AS query, 'book' AS domain FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    from .flows import Domain, standard_items

    cache = t("labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("key"), F.lit("good").alias("value"))
    return standard_items(t("documents").drop("lang"), Domain("book", "doc_id", {"Title": "source"}, ("description", "text")), queries=cache)


@query("X1_grouping_sets", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def _(t):
    return t("documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))
