"""Coverage, relevance rollups, agreement, run comparison, failure profiles, training history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share), null a value of its own."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.withColumn("share", F.col("n") / F.lit(total or 1))


def coverage(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, filled, n, share): how many values are not blank, a row for each column."""
    one = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~T.blank(F.col(c).cast("string"))).alias(f"_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("filled")) for c in columns]))
    return one.select(*(by or []), "n", rows.alias("r")).select(*(by or []), "r.column", "r.filled", "n", (F.col("r.filled") / F.col("n")).alias("share"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, rows whose key occurs again, rows beyond the first, their share."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    out = per.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("keys"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("in_duplicates"), F.sum(F.col("c") - 1).alias("extra"))
    return out.withColumn("extra_share", F.col("extra") / F.col("n"))


def failure_rates(df: DataFrame, by: str, failed: Column) -> DataFrame:
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failed"))
    return out.withColumn("rate", F.col("failed") / F.col("n"))


def feature_contrast(df: DataFrame, features: list[str], failed: Column, flag: float = 0.25) -> DataFrame:
    """(feature, ok_mean, failed_mean, ratio, flagged): flagged if the ratio is over `flag` away from 1."""
    row = df.agg(*[F.avg(F.when(failed == side, F.col(c))).alias(f"{c}_{n}") for c in features for n, side in (("f", True), ("o", False))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_o").alias("ok_mean"), F.col(f"{c}_f").alias("failed_mean")) for c in features]))
    out = row.select(each.alias("r")).select("r.*").withColumn("ratio", F.when(F.col("ok_mean") != 0, F.col("failed_mean") / F.col("ok_mean")))
    return out.withColumn("flagged", F.abs(F.col("ratio") - 1) > flag)


def run_summary(df: DataFrame, run: str, value: str, grade: str) -> DataFrame:
    """(run, n, mean, se, rate_o, rate_a, rate_x); se from the sample deviation."""
    rate = lambda g: F.avg((F.col(grade) == g).cast("double")).alias(f"rate_{g}")
    return df.groupBy(run).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), rate("o"), rate("a"), rate("x"))


def run_difference(df: DataFrame, run: str, value: str, old: str, new: str) -> DataFrame:
    """One row: delta of the means, its standard error, delta / se, and how to read it."""
    side = lambda r, f: f(F.when(F.col(run) == r, F.col(value)))
    out = df.agg((side(new, F.avg) - side(old, F.avg)).alias("delta"), F.sqrt(side(new, F.var_samp) / side(new, F.count) + side(old, F.var_samp) / side(old, F.count)).alias("se"))
    ratio = F.when(F.col("se") > 0, F.col("delta") / F.col("se"))
    return out.withColumn("ratio", ratio).withColumn("reading", F.when(F.abs("ratio") >= 2, "significant").when(F.abs("ratio") < 1, "noise").otherwise("unclear"))


def pivot_mean(df: DataFrame, rows: list[str], columns: str, values: list[str], value: str, digits: int = 4) -> DataFrame:
    """The columns' values are given, so no pass is spent to find them."""
    return df.groupBy(*rows).pivot(columns, values).agg(F.round(F.avg(value), digits))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, share of equal ratings, share at most one step apart."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.avg((F.abs(F.col(a) - F.col(b)) <= 1).cast("double")).alias("adjacent"))


def epoch_means(history: DataFrame) -> DataFrame:
    """(stage, metric, epoch, value) of a history (stage, metric, epoch, step, value)."""
    return history.groupBy("stage", "metric", "epoch").agg(F.avg("value").alias("value"))


def best_epoch(history: DataFrame, metric: str = "val_loss") -> DataFrame:
    """(stage, best_epoch, best_value): the earliest epoch of the smallest mean."""
    means = epoch_means(history.where(F.col("metric") == metric))
    return means.groupBy("stage").agg(F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"), F.min("value").alias("best_value"))


def early_stopping(series: DataFrame, by: str, order: str, value: str, patience: int = 3) -> DataFrame:
    """series with `best`, `misses` and `stopped`: a strictly smaller value resets the misses; after `patience` misses in a
    row the series stops, and later rows are stopped too."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(value) < before)
    rows = series.withColumn("best", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w)).withColumn("_better", better)
    rows = rows.withColumn("misses", (F.col("_n") - F.max(F.when(F.col("_better"), F.col("_n"))).over(w)).cast("int"))
    out = rows.withColumn("stopped", F.max(F.col("misses") >= patience).over(w))
    return out.drop("_n", "_better")


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the entry in the middle of the descending list, the upper one of two (no mean of both)."""
    n = df.where(F.col(value).isNotNull()).count()
    return df.agg(F.expr(f"percentile_disc({(n - n // 2) / n if n else 0.5}) WITHIN GROUP (ORDER BY `{value}`)").alias("upper_median"), F.count(value).alias("n"))
