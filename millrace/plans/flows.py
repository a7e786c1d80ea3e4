"""Whole flows: standard items from a catalog, the training set, evaluation of a retrieval run, quality report, serving."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import merge as M
from ..operators import nearcopies as D
from ..operators import retrieval as R


@dataclass(frozen=True)
class Domain:
    """How a catalog becomes standard items: its id, its labelled fields, where the description is taken from, its image."""

    name: str
    id_col: str
    fields: dict[str, str]
    descriptions: tuple[str, ...]
    image: str | None = None
    query: str = "query"


@dataclass(frozen=True)
class Config:
    """Settings of a run; texts that are cut, tests and patience."""

    description_chars: int = 600
    lyrics_chars: int = 500
    test: float = 0.2
    val: float = 0.1
    patience: int = 3
    temperature: float = 0.07
    ks: tuple[int, ...] = field(default=(1, 5, 10))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Config:
        raw = json.loads(text)
        return Config(**{**raw, "ks": tuple(raw["ks"])})


def optional(df: DataFrame, name: str | None) -> Column:
    """The column, or null where the frame has none of that name."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def standard_items(df: DataFrame, domain: Domain, queries: DataFrame | None = None, files: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """(item_id, content_text, image_path, query, domain): labelled content, a local image before a URL, cached queries
    before old ones. queries: (key, value); files: (item_id, path)."""
    config = config or Config()
    values = {label: optional(df, c) for label, c in domain.fields.items()}
    values["Description"] = T.priority(*[optional(df, c) for c in domain.descriptions])
    url = T.clean(optional(df, domain.image))
    out = df.select(
        F.col(f"`{domain.id_col}`").cast("string").alias("item_id"), T.content_text(config.description_chars, **values).alias("content_text"),
        F.when(url.startswith("http"), url).otherwise("").alias("image_path"), optional(df, domain.query).alias("query"), F.lit(domain.name).alias("domain"),
    )
    if queries is not None:
        out = M.overlay(out, queries.select(F.col("key").alias("item_id"), "value"), "item_id", "query", "value")
    if files is not None:
        out = M.lookup(out, files.select("item_id", F.col("path").alias("_path")), "item_id").withColumn("image_path", F.coalesce("_path", "image_path")).drop("_path")
    return out


def training_set(frames: list[DataFrame], need_query: bool = True, need_image: bool = False) -> DataFrame:
    rows = reduce(DataFrame.unionByName, frames)
    rows = rows.where(~T.blank(F.col("query"))) if need_query else rows
    return rows.where(F.col("image_path") != "") if need_image else rows


def meta(df: DataFrame, id_col: str, domain: str, title: str, extra: dict[str, str]) -> DataFrame:
    """(item_id, domain, title, extra): extra a map, so that domains of other fields can be united."""
    entries = F.map_filter(F.create_map(*[x for k, c in extra.items() for x in (F.lit(k), optional(df, c))]), lambda k, v: ~T.blank(v))
    return df.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.lit(domain).alias("domain"), optional(df, title).alias("title"), entries.alias("extra"))


def retrieval_report(queries: DataFrame, items: DataFrame, gold: Column, config: Config | None = None) -> DataFrame:
    """Metrics of queries (q, qv) against items (embedding); `gold` marks a query's own item."""
    return R.rank_metrics(R.gold_ranks(R.scored(queries, items), "q", gold), (config or Config()).ks)


def quality_report(df: DataFrame, id_col: str, text_col: str, source_col: str, stratum: str) -> dict[str, DataFrame]:
    """Coverage, exact and near copies, broken rules, words shared with the source, all by stratum where that makes sense."""
    bare = F.col(text_col)
    rules = [F.avg(bare.rlike(p).cast("double")).alias(name) for name, p in T.RULES.items()]
    claim = F.avg(bare.rlike(T.NARRATIVE).cast("double")).alias("narrative")
    shared = F.avg(T.overlap(T.content_words(bare), T.content_words(F.col(source_col)))).alias("shared_words")
    return {
        "coverage": E.coverage(df, [text_col, source_col], [stratum]),
        "copies": E.duplicates(df, text_col),
        "near_copies": D.near_copies(df, id_col, text_col),
        "rules": df.groupBy(stratum).agg(*rules, claim, F.avg(T.sentences(bare)).alias("sentences")),
        "overlap": df.groupBy(stratum).agg(shared),
    }


def collapsed(new_rate: Column, old_rate: Column) -> Column:
    """Whether the share of copies has grown from the control to over 1.5 times it, and a hundredth."""
    return new_rate > 1.5 * old_rate + 0.01


class Recommender:
    """Vectors in, neighbours out. fit() keeps an index frame (item_id, domain, embedding, title, extra); predict() answers a
    vector; the encoder that makes vectors of texts is the caller's."""

    def __init__(self, spark: SparkSession, encode=None) -> None:
        self.spark, self.encode, self.index = spark, encode, None

    def fit(self, items: DataFrame) -> Recommender:
        self.index = items.withColumn("embedding", N.unit(F.col("embedding")))
        return self

    def predict(self, query: str | list[float], top_k: int = 10, domain: str | None = None) -> DataFrame:
        if self.index is None:
            raise RuntimeError("no index: fit or load first")
        if not 1 <= top_k <= 100:
            raise ValueError("top_k must be from 1 to 100")
        if domain is not None and domain not in ("movie", "music", "book"):
            raise ValueError(f"unknown domain {domain}")
        if isinstance(query, str):
            if self.encode is None:
                raise RuntimeError("a text needs an encoder")
            query = self.encode(query)
        return R.search(self.index, query, top_k, domain)

    def item(self, item_id: str, domain: str) -> dict | None:
        """{title, ...extra} of an item; None if there is none."""
        row = self.index.where((F.col("item_id") == item_id) & (F.col("domain") == domain)).select("title", "extra").first()
        return None if row is None else {"title": row["title"], **(row["extra"] or {})}

    def health(self) -> dict:
        counts = {} if self.index is None else {r["domain"]: r["count"] for r in self.index.groupBy("domain").count().collect()}
        return {"ready": bool(counts), "items": counts}

    def evaluate(self, queries: DataFrame, gold: Column) -> DataFrame:
        return retrieval_report(queries, self.index, gold)

    def save(self, path: str) -> None:
        R.write_index(self.index, path)

    def load(self, path: str) -> Recommender:
        self.index = R.read_index(self.spark, path)
        return self
