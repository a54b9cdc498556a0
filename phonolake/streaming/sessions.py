"""Structured Streaming versions of the gap-merging and profile operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(df: DataFrame, by: str, time: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a key: rows that follow each other by less than gap. Works on tables and on streams alike."""
    rows = df.withWatermark(time, lateness) if df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_profile(df: DataFrame, by: str, time: str, value: str, width: str, lateness: str) -> DataFrame:
    """Rows and exact sum of a value for each key and window of time."""
    rows = df.withWatermark(time, lateness) if df.isStreaming else df
    out = rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(20,6)")).cast("double").alias("total"))
    return out.select(by, F.col("w.start").alias("start"), "n", "total")
