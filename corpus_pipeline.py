"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, mixing, packing, simhash, substring
from millrace.llm.common import stored


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under plain names, which no output of a stage can clash with, and the plain name of each column."""
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(k) for c, k in name.items()]), name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from the rows that name a language. Rows without a letter go; the others take the predicted lang.

    Where no row names a language, rows with a letter keep their null.
    """
    model = language.fit(docs.where("lang IS NOT NULL"))
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    apart, name = _apart(docs)
    out = language.identify(apart, model, text_col=name["text"], lang_out="found", score_out="score").where("found <> 'und'")
    return out.select(*[F.col("found" if c == "lang" else name[c]).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return simhash.near_dedup(docs, shingle=5, least=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of words seen earlier are cut out; a document of which nothing is left goes. n_chars follows the text."""
    apart, name = _apart(docs)
    out = substring.substring_dedup(apart, name["doc_id"], name["text"]).where("_removed < _words OR _words = 0")
    return out.select(*[F.length(name["text"]).cast("long").alias(c) if c == "n_chars" else F.col(name[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities that bring source, language and topic to their target weights."""
    apart, name = _apart(docs)
    out = mixing.mix(apart, name["doc_id"], name["text"], name["source"], name["lang"]).where("_kept")
    return out.select(*[F.col(name[c]).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences, with their places in the packed sequences."""
    return packing.pack(docs)


STAGES = [("language ID", language_stage), ("SimHash near-dedup", simhash_stage), ("substring dedup", substring_stage), ("mixing to target weights", mixing_stage), ("packing", packing_stage)]

#: SQL has neither the language model nor the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
