"""Queries of sources, sinks and the stored index: each writes with the library, reads back and returns what came.

They write to new folders of S.shared_path, which stay, as the returned frames read them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..sources import tables as S
from .catalog_queries import query
from .flows import Domain, Recommender, standard_items, training_set


@query("S1_csv", "SELECT doc_id, text FROM documents")
def _(t):
    docs = t("documents").select("doc_id", "text")
    path = S.shared_path(docs.sparkSession, "csv")
    S.write_csv(docs, path)
    return S.read_csv(docs.sparkSession, path, "doc_id long, text string")


@query("S3_csv_bad_bytes", "SELECT p_partkey::VARCHAR AS p_partkey, 'caf' || chr(65533) || '-' || p_name AS name FROM part")
def _(t):
    rows = t("part").select("p_partkey", F.concat(F.lit("caf\u00e9-"), F.col("p_name")).alias("name"))
    path = S.shared_path(rows.sparkSession, "latin")
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)  # no UTF-8
    return S.read_csv(rows.sparkSession, path)


@query("S6_tries_cache", "SELECT doc_id::VARCHAR AS key, source AS desc, CASE WHEN doc_id % 2 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id % 7)::INT END AS tries FROM documents WHERE source IS NOT NULL")
def _(t):
    docs = t("documents").where("source IS NOT NULL")
    key = F.col("doc_id").cast("string")
    old = F.to_json(F.create_map(key, F.col("source")))
    tries = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7)  # left out where null
    new = F.to_json(F.create_map(key, F.struct(F.col("source").alias("desc"), tries.alias("tries"))))
    path = S.shared_path(docs.sparkSession, "tries")
    docs.select(F.when(F.col("doc_id") % 2 == 0, old).otherwise(new).alias("value")).write.text(path)
    return S.read_tries_cache(docs.sparkSession, path, lines=True).select("key", "desc", "tries")


@query("S8_cache_shards", "SELECT doc_id::VARCHAR AS key, text AS value FROM documents WHERE text IS NOT NULL")
def _(t):
    docs = t("documents").where("text IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("string"))
    path = S.shared_path(docs.sparkSession, "shards")
    for k in range(2):
        S.write_cache(docs.where(F.col("doc_id") % 2 == k), f"{path}/shard{k}", "doc_id", "text")
    return S.read_cache(docs.sparkSession, f"{path}/shard*", lines=True)


@query("S9_csv_byte_order_mark", "SELECT chr(65279) || 'n_nationkey,n_name' AS line UNION ALL SELECT n_nationkey || ',' || n_name FROM nation")
def _(t):
    nation = t("nation").select("n_nationkey", "n_name").coalesce(1)
    path = S.shared_path(nation.sparkSession, "bom")
    S.write_csv(nation, path, bom=True)
    files = nation.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return files.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")


@query("S11_checkpoint", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    orders = t("orders").select("o_orderkey", "o_totalprice")
    path = S.shared_path(orders.sparkSession, "checkpoint")
    S.append_checkpoint(orders.where("o_orderkey % 3 = 0"), path, "o_orderkey")
    S.append_checkpoint(orders, path, "o_orderkey")  # after a restart: all again
    return S.append_checkpoint(orders, path, "o_orderkey")


@query("S12_versions", "SELECT c_custkey, c_name, '2024-01-01' AS version, (SELECT count(*) FROM customer) AS dry_rows FROM customer UNION ALL SELECT c_custkey, c_name, '2024-01-02', (SELECT count(*) FROM customer) FROM customer WHERE c_custkey % 2 = 0")
def _(t):
    rows = t("customer").select("c_custkey", "c_name")
    path = S.shared_path(rows.sparkSession, "versions")
    S.versioned_overwrite(rows, path, date(2024, 1, 1))
    S.versioned_overwrite(rows.where("c_custkey % 2 = 0"), path, date(2024, 1, 2))
    told = S.versioned_overwrite(rows, path, date(2024, 1, 3), dry_run=True)
    return rows.sparkSession.read.parquet(path).select("c_custkey", "c_name", F.col("version").cast("string"), F.lit(told["rows"]).cast("long").alias("dry_rows"))


@query("S14_report", "SELECT 'nations: ' || (SELECT count(*) FROM nation) || chr(10) || 'regions: ' || (SELECT count(*) FROM region) || chr(10) AS report")
def _(t):
    text = S.report([("nations", t("nation").count()), ("regions", t("region").count())])
    return t("region").sparkSession.range(1).select(F.lit(text).alias("report"))


def _answer(request: str) -> str:
    if request.endswith("7"):
        raise ValueError(request)
    return request.upper()


@query("S16_fetch", "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 7 THEN 'HTTP://HOST' || p_partkey % 3 || '/' || p_partkey END AS response, CASE WHEN p_partkey % 10 = 7 THEN 'ValueError: http://host' || p_partkey % 3 || '/' || p_partkey END AS error FROM part")
def _(t):
    url = F.concat(F.lit("http://host"), F.col("p_partkey") % 3, F.lit("/"), F.col("p_partkey"))
    return S.fetched(t("part").select("p_partkey", url.alias("url")), "p_partkey", "url", _answer, host_parts=4)


def _answers(prompts: list[str]) -> list[str]:
    return [_answer(p) for p in prompts]  # one bad prompt fails its whole batch


@query("R10_bisect", "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 7 THEN 'PART ' || p_partkey END AS output, CASE WHEN p_partkey % 10 = 7 THEN 'ValueError: part ' || p_partkey END AS error FROM part")
def _(t):
    rows = t("part").select("p_partkey", F.concat(F.lit("part "), F.col("p_partkey")).alias("prompt"))
    return S.generated(rows, "p_partkey", "prompt", _answers, batch=32)


@query("F5_with_image", "SELECT p_partkey, 'http://x/' || p_partkey AS image_path FROM part WHERE p_partkey % 3 <> 2")
def _(t):
    rows = t("part").withColumn("img", F.when(F.col("p_partkey") % 3 != 2, F.concat(F.lit("http://x/"), F.col("p_partkey"))).otherwise("no"))
    items = standard_items(rows, Domain("book", "p_partkey", {"Title": "p_name"}, ("p_type",), "img"))
    return training_set([items], need_query=False, need_image=True).select(F.col("item_id").cast("long").alias("p_partkey"), "image_path")


@query("M14_saved_index_search", """SELECT vec_id::VARCHAR AS item_id, 'book' AS domain, round(score, 5) AS score FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 2 = 0) ORDER BY score DESC, vec_id::VARCHAR LIMIT 10""")
def _(t):
    vectors = t("embeddings")
    path = S.shared_path(vectors.sparkSession, "index")
    domain = F.when(F.col("vec_id") % 2 == 0, "book").otherwise("music")
    Recommender(vectors.sparkSession).fit(vectors.select(F.col("vec_id").cast("string").alias("item_id"), domain.alias("domain"), "embedding")).save(path)
    query_vector = vectors.where("vec_id = 0").first()["embedding"]
    found = Recommender(vectors.sparkSession).load(path).predict(list(query_vector), 10, "book")
    return found.select("item_id", "domain", F.round("score", 5).alias("score"))
