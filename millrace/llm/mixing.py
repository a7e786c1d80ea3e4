"""Mixing sources to target weights by iterative proportional fitting.

Only DataFrame functions. Token weights are summed to a table of cells (source, language, topic), the cells are raked to the
three target marginals in turn, and documents are kept with their cell's calibrated probability, decided by a hash of the id.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

# Words that mark a topic, in English, German, French and Spanish; the first topic with a hit is taken.
TOPICS = {
    "science": ["science", "wissenschaft", "ciencia", "theor"],
    "law": ["licens", "gesetz", "tribunal", "rights"],
    "health": ["health", "gesundheit", "santé", "salud"],
    "money": ["market", "wirtschaft", "argent", "dinero"],
    "technology": ["token", "passw", "software", "http"],
}


def topic(text: Column) -> Column:
    """A topic by marker words, else by form: tables, short notes, articles and long texts. Null for a null text."""
    low = F.lower(text)
    out = F.when(F.contains(text, F.lit(" | ")), "table").when(F.length(text) < 500, "note").when(F.length(text) < 5000, "article").when(text.isNotNull(), "long")
    for name in reversed(TOPICS):
        hit = F.lit(False)
        for w in TOPICS[name]:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id alone."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def raked(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame] | None = None, temper: float = 0.7, rounds: int = 8) -> DataFrame:
    """cells (dims..., tokens) with `weight`: tokens raked in turn so that each dimension's marginal meets its target.

    targets: by dimension, a frame (value, share) whose shares sum to one over the values that occur; else a value's share is
    its tokens to the power `temper`, scaled, which lifts small values. A cell without tokens stays without.

    Any number of values may be in the first dimension: its factor is found where its cells are, in one row for each value.
    The other dimensions are vocabularies (languages, topics): a round sums the cells of each of their combinations, and
    the factors of those few are brought forward by the driver.
    """
    first, rest = dims[0], dims[1:]
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    key = F.to_json(F.array(*[F.col(d).cast("string") for d in rest]))
    by = cells.groupBy(first).agg(F.collect_list(F.struct(key.alias("key"), F.col("tokens").cast("double").alias("tokens"), F.struct(*cells.columns).alias("cell"))).alias("_cells"), F.sum("tokens").cast("double").alias("_n"))
    if targets and first in targets:
        want = targets[first].select(F.col("value").alias("_value"), (F.col("share") * F.lit(total)).alias("_want"))
        by = by.join(want, F.col(first).eqNullSafe(F.col("_value")), "left").select("_cells", F.coalesce("_want", F.lit(0.0)).alias("_want"))
    else:
        scale = by.agg(F.sum(F.pow("_n", F.lit(temper)))).first()[0] or 1.0
        by = by.select("_cells", (F.pow("_n", F.lit(temper)) / F.lit(float(scale)) * F.lit(total)).alias("_want"))
    by = stored(by, "mixing-by")

    per = {r["key"]: float(r["n"]) for r in cells.groupBy(key.alias("key")).agg(F.sum("tokens").alias("n")).collect()}
    goals: list[dict] = []
    for k, d in enumerate(rest):
        n: dict = {}
        for name, x in per.items():
            n[json.loads(name)[k]] = n.get(json.loads(name)[k], 0.0) + x
        if targets and d in targets:
            share = {r["value"]: float(r["share"]) for r in targets[d].collect()}
            goals.append({v: share.get(v, 0.0) * total for v in n})
        else:
            scale = sum(x**temper for x in n.values()) or 1.0
            goals.append({v: x**temper / scale * total for v, x in n.items()})

    factor = dict.fromkeys(per, 1.0)

    def scaled() -> DataFrame:
        """Cells with the weight that meets the first dimension's targets under the present factors of the others."""
        each = F.from_json(F.lit(json.dumps(factor)), "map<string,double>")
        weighed = F.transform("_cells", lambda c: F.struct(c["key"].alias("key"), (c["tokens"] * F.element_at(each, c["key"])).alias("w"), c["cell"].alias("cell")))
        now = F.aggregate("_weighed", F.lit(0.0), lambda sum_, c: sum_ + c["w"])
        out = by.select("_want", weighed.alias("_weighed")).select(F.when(now > 0, F.col("_want") / now).otherwise(0.0).alias("_by"), F.explode("_weighed").alias("c"))
        return out.select("c.key", "c.cell", (F.col("c.w") * F.col("_by")).alias("w"))

    for left in range(rounds, 0, -1):
        if left == 1:
            last = stored(scaled(), "mixing-last")
        found = (last if left == 1 else scaled()).groupBy("key").agg(F.sum("w").alias("w"))
        sums, change = {r["key"]: r["w"] for r in found.collect()}, dict.fromkeys(per, 1.0)
        for k, goal in enumerate(goals):
            now = dict.fromkeys(goal, 0.0)
            for name, w in sums.items():
                now[json.loads(name)[k]] += w * change[name]
            for name in change:
                v = json.loads(name)[k]
                change[name] *= goal[v] / now[v] if now[v] > 0 else 0.0
        factor = {name: x * change[name] for name, x in factor.items()}
    discard(by)
    more = F.from_json(F.lit(json.dumps(change)), "map<string,double>")
    return last.select("cell.*", (F.col("w") * F.element_at(more, F.col("key"))).alias("weight"))


def calibrated(cells: DataFrame, share: float, rounds: int = 10) -> DataFrame:
    """cells (tokens, weight) with `probability`: in proportion to weight per token, at most 1, and so that `share` of all
    tokens is expected to stay."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    factor = float(share)
    for _ in range(rounds):
        p = ratio * F.lit(factor)
        full, rest = cells.agg(F.sum(F.when(p >= 1, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(p < 1, F.col("tokens") * p).otherwise(0.0))).first()
        if not rest or share * total <= full:
            break
        grown = factor * (share * total - full) / rest
        if grown == factor:
            break
        factor = grown
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(factor)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    targets: dict[str, DataFrame] | None = None,
    temper: float = 0.7,
    share: float = 0.7,
    seed: int = 9,
) -> DataFrame:
    """docs with _topic, _tokens, _weight (the row's raked tokens), _probability and _kept.

    Dimensions are source, lang and topic (topic_col, or marker words and form of the text); null is a value like any other
    in each. _kept: the hash of the id is under the cell's probability, so rows that share an id share a draw, and rows
    without id share one. Null and empty texts weigh nothing and are kept with the probability of a document of weight one.
    Empty tables give none. All columns of docs stay as they are, whatever their names; only a column with the name of an
    output is replaced by it.
    """
    dims = ["source", "lang", "topic"]
    rest = [c for c in docs.columns if c not in ("_topic", "_tokens", "_weight", "_probability", "_kept")]
    of = lambda c: F.col(f"`{c}`")
    rows = docs.select(
        *[of(c).alias(f"c{k}") for k, c in enumerate(rest)], of(id_col).alias("id"), of(source_col).cast("string").alias("source"), of(lang_col).cast("string").alias("lang"),
        (of(topic_col).cast("string") if topic_col else topic(of(text_col))).alias("topic"), tokens(of(text_col)).alias("tokens"),
    )
    cells = stored(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "mixing-cells")
    weighed = stored(raked(cells, dims, targets, temper), "mixing-raked")
    right = calibrated(weighed, share)
    right = right.select(*[F.col(d).alias(f"cell_{d}") for d in dims], F.col("tokens").alias("cell_tokens"), F.col("weight").alias("cell_weight"), "probability")
    on = F.col("source").eqNullSafe(F.col("cell_source")) & F.col("lang").eqNullSafe(F.col("cell_lang")) & F.col("topic").eqNullSafe(F.col("cell_topic"))
    weight = F.when(F.col("cell_tokens") > 0, F.col("tokens") * F.col("cell_weight") / F.col("cell_tokens")).otherwise(0.0)
    return rows.join(right, on, "left").select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(rest)], F.col("topic").alias("_topic"), F.col("tokens").alias("_tokens"), weight.alias("_weight"),
        F.col("probability").alias("_probability"), (chance(F.col("id"), seed) < F.col("probability")).alias("_kept"),
    )


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 4).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"))


def _sql(temper: float = 0.7, share: float = 0.7, seed: int = 9, rounds: int = 8, fits: int = 10) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN '{name}'" for name, words in TOPICS.items())
    ctes = [
        rf"""docs AS (SELECT doc_id, source, lang, CASE {cases} WHEN contains(text, ' | ') THEN 'table' WHEN length(text) < 500 THEN 'note'
            WHEN length(text) < 5000 THEN 'article' WHEN text IS NOT NULL THEN 'long' END AS topic,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 8))::UBIGINT / 4294967296.0 AS u FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS t FROM cells)",
    ]
    for d in ("source", "lang", "topic"):
        ctes.append(f"per_{d} AS (SELECT {d}, pow(sum(tokens), {temper}) AS p FROM cells GROUP BY {d})")
        ctes.append(f"want_{d} AS (SELECT {d}, p / (SELECT sum(p) FROM per_{d}) * (SELECT t FROM total) AS target_{d} FROM per_{d})")
    ctes.append(
        "w0 AS (SELECT c.*, tokens AS weight, target_source, target_lang, target_topic FROM cells c JOIN want_source a ON c.source IS NOT DISTINCT FROM a.source "
        "JOIN want_lang b ON c.lang IS NOT DISTINCT FROM b.lang JOIN want_topic d ON c.topic IS NOT DISTINCT FROM d.topic)"
    )
    k = 0
    for _ in range(rounds):
        for d in ("source", "lang", "topic"):
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER p > 0 THEN weight * target_{d} / sum(weight) OVER p ELSE 0 END AS weight) FROM w{k} WINDOW p AS (PARTITION BY {d}))")
            k += 1
    ctes.append(f"r AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS ratio FROM w{k})")
    ctes.append(f"f0 AS (SELECT {share}::DOUBLE AS f)")
    for j in range(fits):
        ctes.append(
            f"f{j + 1} AS MATERIALIZED (SELECT CASE WHEN rest > 0 AND {share} * t > capped THEN f * ({share} * t - capped) / rest ELSE f END AS f FROM (SELECT any_value(f) AS f, any_value(t) AS t, "
            f"sum(CASE WHEN ratio * f >= 1 THEN tokens ELSE 0 END) AS capped, sum(CASE WHEN ratio * f < 1 THEN tokens * ratio * f ELSE 0 END) AS rest FROM r, f{j}, total))"
        )
    return (
        "WITH " + ", ".join(ctes) + f""" SELECT doc_id, docs.topic, n::BIGINT AS n_tokens, round(CASE WHEN tokens > 0 THEN n * weight / tokens ELSE 0 END, 4) AS weight,
        round(least(1.0, ratio * f), 6) AS probability, u < least(1.0, ratio * f) AS kept FROM docs JOIN r ON docs.source IS NOT DISTINCT FROM r.source
        AND docs.lang IS NOT DISTINCT FROM r.lang AND docs.topic IS NOT DISTINCT FROM r.topic, f{fits}"""
    )


SQL = _sql()
