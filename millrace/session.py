"""Session defaults: adaptive plans, UTC, ANSI casts."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "millrace", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map={**DEFAULTS, **more}).getOrCreate()
