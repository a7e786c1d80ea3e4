"""Lookups, overlays, de-duplication and merges by key. Every order that decides something is explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .features import numbered


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of every key in this order.

    An aggregate, not a window: rows are reduced before the shuffle, so a key of any size is no burden for one task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranks = [c if isinstance(c, Column) else F.col(c) for c in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*ranks)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def lookup(df: DataFrame, cache: DataFrame, key: str, how: str = "left", order: str | None = None) -> DataFrame:
    """Join of a cache whose keys are made unique first, so that no row is multiplied.

    Of the rows of a key the last by `order` counts, all its values together; ties, and a cache without an order, go to the
    row whose values are the largest.
    """
    values = [c for c in cache.columns if c != key and c != order]
    row = F.struct(*[F.col(c) for c in values])
    last = F.max(row) if order is None else F.max_by(row, F.struct(F.col(order), row))
    unique = cache.groupBy(key).agg(last.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in values]) if values else cache.select(key).distinct()
    return df.join(unique, key, how)


def overlay(df: DataFrame, cache: DataFrame, key: str, column: str, value: str, where: str = "filled") -> DataFrame:
    """df with `column` replaced from the cache's `value`.

    where: `filled`, only if the new value is not blank; `missing`, only if the old one is blank and there is a new one;
    `present`, wherever the key is in the cache, a null included.
    """
    new = cache.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    joined = lookup(df, new, key)
    old = F.col(column)
    out = {
        "filled": F.when(~T.blank(F.col("_new")), F.col("_new")).otherwise(old),
        "missing": F.when(T.blank(old) & F.col("_hit"), F.col("_new")).otherwise(old),
        "present": F.when(F.col("_hit"), F.col("_new")).otherwise(old),
    }[where]
    return joined.withColumn(column, out).select(*df.columns)


def remaining(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return df.join(cache.select(key), key, "left_anti")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys in one frame only."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def ranked_union(frames: list[DataFrame], rank: str = "source_rank") -> DataFrame:
    """All rows, with the place of their frame; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(rank, F.lit(k)) for k, f in enumerate(frames)])


def merge_sources(frames: list[DataFrame], id_col: str, title: str, author: str, text: str, order: str, least_chars: int = 80) -> DataFrame:
    """Sources merged by priority: texts that are not blank and long enough, then one row for each id within a source, then
    one for each (title, author) key over all, from the first source that has it."""
    rows = ranked_union(frames).withColumn("_key", T.item_key(F.col(title), F.col(author)))
    rows = rows.where(~T.blank(F.col(text)) & (F.length(text) >= least_chars))
    rows = first_by(rows, ["source_rank", id_col], order)
    return first_by(rows, ["_key"], "source_rank", order).drop("_key")


def drop_duplicates_by_information(df: DataFrame, key: str, informative: list[str], order: str) -> DataFrame:
    """One row for each key: with the most columns filled, then the first."""
    score = reduce(lambda a, b: a + b, [(~T.blank(F.col(c))).cast("int") for c in informative])
    return first_by(df.withColumn("_score", score), [key], -F.col("_score"), order).drop("_score")


def merge_shards(shards: DataFrame, key: str, value: str, tries: str, order: str) -> DataFrame:
    """One result for each key: the first that is filled, else the empty one with the most tries."""
    filled = ~T.blank(F.col(value))
    return first_by(shards, [key], F.when(filled, 0).otherwise(1), F.when(filled, F.lit(0)).otherwise(-F.col(tries)), order)


def work_queue(items: DataFrame, cache: DataFrame, key: str, value: str, tries: str, most_tries: int) -> DataFrame:
    """Items still to do: without a result, tried fewer times than allowed."""
    done = cache.where(~T.blank(F.col(value)) | (F.col(tries) >= most_tries))
    return remaining(items, done, key)


def sharded(df: DataFrame, place: Column, shard: int, shards: int) -> DataFrame:
    return df.where(F.pmod(place, F.lit(shards)) == shard)


def chunked(df: DataFrame, order: str, size: int, by: list[str]) -> DataFrame:
    """df with `chunk`: `size` rows each within a group, in the order of a number."""
    rows = numbered(df, F.col(order), by=by)
    return rows.withColumn("chunk", F.floor(F.col("place") / size).cast("long")).drop("place")


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(order).alias("first_place"))


def guard_coverage(df: DataFrame, column: str, least: float = 0.95) -> float:
    """The share of rows in which the column is filled; an error below `least`."""
    share = df.agg(F.avg((~T.blank(F.col(column))).cast("double"))).first()[0] or 0.0
    if share < least:
        raise ValueError(f"{column} is filled in {share:.4f} of the rows; {least} is needed")
    return share


def toggled(saved: Column, item: Column) -> Column:
    """A list of saved ids with the item taken out if it is there, else added."""
    return F.when(F.array_contains(saved, item), F.array_remove(saved, item)).otherwise(F.array_append(saved, item))


def rotated(items: Column, shift: Column) -> Column:
    """The list begun at another place, wrapping around."""
    k = F.pmod(shift, F.greatest(F.size(items), F.lit(1))).cast("int")
    return F.concat(F.slice(items, k + 1, F.size(items)), F.slice(items, F.lit(1), k))
