"""Scans and sinks: CSV, Parquet, JSON caches, binary files, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that all machines see: in spark.checkpoint.dir, or in the warehouse where that is unset. The caller's to remove."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Quoted fields may hold line breaks; without a schema every column is text; bad bytes become replacement marks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*columns) if columns else df


def read_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(key, value) of JSON objects, one to a file, or one to a line, as write_cache makes them; a glob reads shards.

    Files of lines are split among tasks; one object that fills a file is read by one.
    """
    whole = spark.read.option("wholetext", not lines).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")))


def read_tries_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(key, desc, tries, file): entries are objects, or, in the old form, the text alone, which counts as one try."""
    whole = spark.read.option("wholetext", not lines).text(path).withColumn("file", F.input_file_name())
    entries = whole.select("file", F.explode(F.from_json("value", "map<string,string>")))
    new = F.from_json("value", "desc string, tries int")
    is_new = F.col("value").rlike(r"^\s*\{")
    return entries.select("key", F.when(is_new, new["desc"]).otherwise(F.col("value")).alias("desc"), F.when(is_new, F.coalesce(new["tries"], F.lit(0))).otherwise(1).alias("tries"), "file")


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """With a byte-order mark the first column's name carries it; blanks at the ends of values are kept."""
    names = [("﻿" if bom and k == 0 else "") + c for k, c in enumerate(df.columns)]
    df.toDF(*names).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_cache(df: DataFrame, path: str, key: str, value: str) -> None:
    """JSON objects {key: value}, one to a line."""
    df.select(F.to_json(F.create_map(F.col(key), F.col(value))).alias("value")).write.mode("overwrite").text(path)


def append_checkpoint(done: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key is not stored yet are appended; a restart appends nothing twice, rows without a key included.

    One writer at a time. A folder that does not exist yet, or is empty, holds nothing.
    """
    spark = done.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        old = spark.read.schema(done.schema).parquet(path).select(F.col(key).alias("_stored")).distinct()
        done = done.join(old, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")
    done.write.mode("append").parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def versioned_overwrite(df: DataFrame, path: str, run_date: date, dry_run: bool = False) -> dict[str, int | str]:
    """A new version beside the old ones; with dry_run only the counts."""
    target = f"{path}/version={run_date.isoformat()}"
    out: dict[str, int | str] = {"rows": df.count(), "path": target}
    if not dry_run:
        df.write.mode("overwrite").parquet(target)
    return out


def boards(df: DataFrame, board: str, order: str, items: Column, most: int = 12) -> DataFrame:
    """(board, json): up to `most` items each, in order, as a JSON list."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), items.alias("i")))), lambda x: x["i"])
    return df.groupBy(board).agg(F.to_json(F.slice(ordered, 1, most)).alias("json"))


def report(rows: Iterable[tuple[str, object]]) -> str:
    return "".join(f"{name}: {value}\n" for name, value in rows)


# Sizes below which an image is rejected, or needs no further proof.
SMALLEST_IMAGE, SURE_IMAGE = 1024, 3000


def image_ok(content: Column, status: Column, placeholders: list[str]) -> Column:
    """Answered, not tiny, and either large enough or not a known placeholder by its MD5."""
    size = F.length(content)
    known = F.md5(content).isin(placeholders) if placeholders else F.lit(False)
    return status.isin(200, 206) & (size >= SMALLEST_IMAGE) & ((size >= SURE_IMAGE) | ~known)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, md5) of image files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.md5("content").alias("md5"))


def fetched(df: DataFrame, key: str, request: str, fetch: Callable[[str], str | None], host_parts: int | None = None) -> DataFrame:
    """(key, response, error): `fetch` is called for each distinct request; a failure is a row, not the end of the job.

    Requests of a host share a partition, so that a fetcher can hold its rate; the fetcher is the caller's.
    """
    rows = df.select(key, request).dropDuplicates([key])
    if host_parts:
        rows = rows.repartition(host_parts, F.coalesce(F.try_parse_url(F.col(request), F.lit("HOST")), F.lit("")))

    def run(frames):
        for pdf in frames:
            out = []
            for k, r in zip(pdf[key], pdf[request]):
                try:
                    out.append((k, fetch(r), None))
                except Exception as e:  # noqa: BLE001  any failure of one request is that row's result
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "response", "error"])

    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, response string, error string")


def generated(df: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """(key, output, error): the model is called with batches of prompts; a batch that fails is halved down to its bad row."""

    def attempt(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(x, None) for x in model(prompts)]
        except Exception as e:  # noqa: BLE001
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(prompts) // 2
            return attempt(prompts[:half]) + attempt(prompts[half:])

    def run(frames):
        for pdf in frames:
            got = [x for k in range(0, len(pdf), batch) for x in attempt(pdf[prompt].iloc[k : k + batch].tolist())]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "output": [g[0] for g in got], "error": [g[1] for g in got]})

    return df.select(key, prompt).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, output string, error string")


def sample_catalog(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Synthetic items for trials, the same for the same seed."""
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    title = F.initcap(F.concat_ws(" ", pick(["quiet", "golden", "last", "broken", "distant"], 1), pick(["river", "letter", "winter", "city", "song"], 2)))
    year = (1960 + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(3)), F.lit(65))).cast("int")
    return spark.range(rows).select(F.col("id").cast("string").alias("item_id"), pick(["movie", "music", "book"], 0).alias("domain"), title.alias("title"), year.alias("year"))
