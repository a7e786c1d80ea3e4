"""Blocks of bounded size in which the members of a bucket meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_blocks(members: DataFrame, key: list[str], payload: list[str], spread: str, cap: int, apart: bool = False) -> DataFrame:
    """Blocks in which every two members of a bucket meet exactly once, each of about 2 * cap members at most.

    A bucket of n members is dealt by a hash of `spread` into ceil(n / cap) chunks; each pair of chunks is a block, so a
    bucket of any size is compared completely without ever standing in one task. Buckets of one member make no block.
    Columns: members, an array of structs (payload..., chunk), and lo, hi, the chunks; lo == hi compares a chunk with
    itself, otherwise only members of different chunks are new pairs. apart=True deals the blocks of a bucket to different
    tasks even where the members of each bucket are in one already; it costs a shuffle.
    """
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / F.lit(cap)).cast("int")
    dealt = members.join(sizes, key).withColumn("_chunks", chunks)
    dealt = dealt.withColumn("chunk", F.when(F.col("_chunks") > 1, F.pmod(F.xxhash64(F.lit(11), spread), F.col("_chunks"))).otherwise(0).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    dealt = dealt.withColumn("lo", F.least("chunk", "_other")).withColumn("hi", F.greatest("chunk", "_other"))
    if apart:
        dealt = dealt.repartition(*key, "lo", "hi")
    return dealt.groupBy(*key, "lo", "hi").agg(F.collect_list(F.struct(*payload, "chunk")).alias("members")).where(F.size("members") > 1)
