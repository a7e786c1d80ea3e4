"""Fitted features, outliers, splits and resampling. A fit is a small frame; applying it is a join that broadcasts by size."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """shift and scale by column; a constant column has scale 1."""

    shift: dict[str, float]
    scale: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], method: str = "standard") -> Scaler:
        two = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        row = df.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in enumerate(two)]).first()
        shift = {c: float(row[f"{c}_0"] or 0) for c in columns}
        raw = {c: float(row[f"{c}_1"] or 0) - (0 if method == "standard" else shift[c]) for c in columns}
        return Scaler(shift, {c: v if v else 1.0 for c, v in raw.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.shift})


def encode_labels(df: DataFrame, column: str, out: str, known: DataFrame | None = None) -> DataFrame:
    """Places of the values in their sorted order, from 0; with `known` (value, code), an unseen value is an error."""
    if known is None:
        known = label_codes(df, column)
    joined = df.join(known.select(F.col("value").alias("_value"), F.col("code").alias("_code")), F.col(column).eqNullSafe(F.col("_value")), "left")
    checked = F.when(F.col("_code").isNull() & F.col(column).isNotNull(), F.raise_error(F.concat(F.lit("unseen label: "), F.col(column).cast("string")))).otherwise(F.col("_code"))
    return joined.withColumn(out, checked).drop("_value", "_code")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values only are ranked, so the one window holds the labels and not the rows."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def fill_missing(df: DataFrame, columns: list[str], method: str = "mean") -> DataFrame:
    """mean, median (exact), zero or drop; any other name is taken as mean. NaN counts as missing."""
    df = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    if method == "drop":
        return df.na.drop(subset=columns)
    if method == "zero":
        return df.na.fill(0.0, subset=columns)
    row = df.agg(*[(F.median(c) if method == "median" else F.avg(c)).alias(c) for c in columns]).first()
    return df.na.fill({c: row[c] for c in columns if row[c] is not None})


def forward_fill(df: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def inside_quartiles(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """df with `inlier`: every column within factor times the quartile distance of its quartiles, ends included."""
    row = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns]).first()
    ok = F.lit(True)
    for c in columns:
        if row[c]:
            low, high = row[c]
            ok = ok & F.col(c).between(low - factor * (high - low), high + factor * (high - low))
    return df.withColumn("inlier", ok)


def inside_deviations(df: DataFrame, columns: list[str], most: float = 3.0) -> DataFrame:
    """df with `inlier`: every column less than `most` population deviations (plus 1e-8) from its mean."""
    row = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.abs((F.col(c) - F.lit(row[f"{c}_m"])) / F.lit((row[f"{c}_s"] or 0.0) + 1e-8)) < most)
    return df.withColumn("inlier", ok)


def isolation_scores(df: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """df with `isolation`: 2 ** (-mean depth / expected depth), near 1 for what random splits isolate early.

    Trees are grown on the driver from samples of at most `sample` rows each and applied as expressions.
    """
    import numpy as np

    rows = df.select(*columns).na.drop()
    n = rows.count()
    share = min(1.0, 2.0 * trees * sample / max(n, 1))
    pool = np.array([list(r) for r in rows.where(F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(4 * trees * sample).collect()], float)
    draw = np.random.default_rng(seed)
    if not len(pool):
        return df.withColumn("isolation", F.lit(None).cast("double"))
    average = lambda m: 0.0 if m < 2 else 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m

    def grow(x, depth: int, deepest: int) -> Column:
        wide = [k for k in range(x.shape[1]) if len(x) and x[:, k].min() < x[:, k].max()]
        if depth >= deepest or len(x) < 2 or not wide:
            return F.lit(depth + average(len(x)))
        k = int(draw.choice(wide))
        cut = float(draw.uniform(x[:, k].min(), x[:, k].max()))
        left = x[:, k] < cut
        return F.when(F.col(columns[k]) < cut, grow(x[left], depth + 1, deepest)).otherwise(grow(x[~left], depth + 1, deepest))

    size = min(sample, len(pool))
    deepest = max(1, min(6, math.ceil(math.log2(size))))  # expressions stay small
    depths = [grow(pool[draw.choice(len(pool), size, replace=False)], 0, deepest) for _ in range(trees)]
    total = depths[0]
    for d in depths[1:]:
        total = total + d
    return df.withColumn("isolation", F.pow(F.lit(2.0), -total / F.lit(trees * max(average(size), 1e-9))))


def shuffled_place(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of rows by their key."""
    return F.xxhash64(key, F.lit(seed))


def _sliced(df: DataFrame, first: Column) -> DataFrame:
    """df with `_slice`: the rows cut at quantiles of a number, nulls in the first slice.

    The cuts are literals, so that every use of the frame sees the same slices, however often it is computed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_first", first.cast("double"))
    cuts = sorted(set(rows.approxQuantile("_first", [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("_first") <= F.lit(cuts[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return rows.withColumn("_slice", F.when(F.col("_first").isNull(), 0).otherwise(place(0, len(cuts)))).drop("_first")


def numbered(df: DataFrame, first: Column, *more: Column, by: list[str] | None = None) -> DataFrame:
    """df with `place`, from 0 in this order, over all rows or within each key; `first` is a number, nulls come first.

    No task sorts all rows, or all of a key: slices are numbered apart, and the rows of earlier slices added.
    """
    by = by or []
    rows = _sliced(df, first)
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(first, *more)))
    sizes = rows.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_slice") == F.col("_of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(sizes, on).withColumn("place", F.col("_in") - 1 + F.col("_before")).select(*df.columns, "place")


def split(df: DataFrame, key: str, test: float, val: float = 0.0, seed: int = 42, up: bool = False) -> DataFrame:
    """df with `part`: exact counts, test = floor (or, with `up`, ceiling) of n * test, val = floor of the rest * val."""
    rows = numbered(df, shuffled_place(F.col(key), seed), F.col(key))
    n = rows.count()
    near = lambda x: round(x) if abs(x - round(x)) < 1e-9 else x  # noqa: E731  0.1 * 30 is no 3 in floating point
    n_test = math.ceil(near(n * test)) if up else math.floor(near(n * test))
    n_val = math.floor(near((n - n_test) * val))
    train = n - n_test - n_val
    return rows.withColumn("part", F.when(F.col("place") < train, "train").when(F.col("place") < train + n_val, "val").otherwise("test")).drop("place")


def balanced(df: DataFrame, label: str, key: str, over: bool = False, seed: int = 42) -> DataFrame:
    """Every class brought to the size of the smallest, or of the largest by repeating its rows in turn (column `copy`)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    least, most = sizes.agg(F.min("_size"), F.max("_size")).first()
    rows = numbered(df, shuffled_place(F.col(key), seed), F.col(key), by=[label]).withColumn("_rank", F.col("place") + 1).drop("place")
    if not over:
        return rows.where(F.col("_rank") <= F.lit(least or 0)).drop("_rank").withColumn("copy", F.lit(0))
    rows = rows.join(sizes, label)
    copies = F.floor((F.lit(most or 0) - F.col("_rank")) / F.col("_size")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("_rank", "_size")


def smote(df: DataFrame, label: str, key: str, columns: list[str], neighbours: int = 5, seed: int = 42) -> DataFrame:
    """(label, columns, base, neighbour): synthetic rows that bring each class to the largest one's size.

    Each lies between a row and one of its nearest neighbours in its class. Neighbours are found within blocks of a class
    dealt by a hash, of about 512 rows each, so that no class stands in one task.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    most = sizes.agg(F.max("_size")).first()[0] or 0
    rows = df.join(sizes.where(F.col("_size") < most), label).select(label, key, "_size", F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(key, F.lit(seed)), F.ceil(F.col("_size") / 512)))
    other = rows.select(label, "_block", F.col(key).alias("neighbour"), F.col("_x").alias("_y"))
    pairs = rows.join(other, [label, "_block"]).where(F.col(key) != F.col("neighbour"))
    gap = F.aggregate(F.zip_with("_x", "_y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(label, key).orderBy(gap, "neighbour"))).where(F.col("_rank") <= neighbours)
    wanted = F.ceil(F.lit(most) / F.col("_size") - 1).cast("int")
    grown = near.groupBy(label, key, "_size", "_x").agg(F.sort_array(F.collect_list(F.struct("_rank", "neighbour", "_y"))).alias("_near"))
    made = grown.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.greatest(wanted - 1, F.lit(0)))))
    draw = F.pmod(F.xxhash64(key, "_copy", F.lit(seed)), F.lit(1 << 20))
    made = made.withColumn("_pick", F.get("_near", F.pmod(draw, F.size("_near")).cast("int"))).withColumn("_t", draw / F.lit(float(1 << 20)))
    point = F.zip_with("_x", F.col("_pick._y"), lambda a, b: a + F.col("_t") * (b - a))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_copy", shuffled_place(F.col(key), seed), key))
    made = made.withColumn("_p", point).withColumn("_place", place).where(F.col("_place") <= F.lit(most) - F.col("_size"))
    return made.select(label, *[F.col("_p")[k].alias(c) for k, c in enumerate(columns)], F.col(key).alias("base"), F.col("_pick.neighbour").alias("neighbour"))


def stratified(df: DataFrame, strata: str, key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """The first rows of each stratum in a fixed random order; a sampling operator, its limit is the feature."""
    rank = F.row_number().over(Window.partitionBy(strata).orderBy(shuffled_place(F.col(key), seed), F.col(key)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= per_stratum).drop("_rank")


def proportional_allocation(df: DataFrame, strata: str, total: int) -> DataFrame:
    """(stratum, n, alloc): rows to draw, in proportion, what rounding leaves going to the largest stratum."""
    sizes = df.groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 1
    sizes = sizes.withColumn("alloc", F.bround(F.col("n") * F.lit(total) / F.lit(n), 0).cast("long"))
    over, largest = sizes.agg(F.lit(total) - F.sum("alloc"), F.max_by(F.struct(strata), F.struct("n", strata))).first()
    return sizes if largest is None else sizes.withColumn("alloc", F.col("alloc") + F.when(F.col(strata).eqNullSafe(F.lit(largest[0])), F.lit(over)).otherwise(0))


def one_of(values: Column, key: Column, epoch: int) -> Column:
    """One entry of a list, another in each epoch."""
    return F.get(values, F.pmod(F.xxhash64(key, F.lit(epoch)), F.greatest(F.size(values), F.lit(1))).cast("int"))
