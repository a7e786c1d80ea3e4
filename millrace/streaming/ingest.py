"""Streams (an extension): new items are appended once, by key, and events are counted by window with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import append_checkpoint


def ingest(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch stores the keys that are not there yet; a batch that is run again stores nothing twice."""

    def store(batch: DataFrame, _: int) -> None:
        append_checkpoint(batch.dropDuplicates([key]), path, key)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_events(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), by, "n", "total")
