"""Streams over the usage log and observations: extensions beyond batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(usage: DataFrame, window: str = "30 days", slide: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, end, id, uses): retrievals per record over sliding windows; later rows than ``late`` drop out."""
    timed = usage.select("id", F.col("retrieved_at").cast("timestamp").alias("at")).where(F.col("id").isNotNull()).withWatermark("at", late)
    return timed.groupBy(F.window("at", window, slide), "id").agg(F.count(F.lit(1)).alias("uses")).select("window.start", "window.end", "id", "uses")


def once_per_session(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each (session, kind): repeats within the watermark are dropped."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["session", "kind"])


def expirations(observations: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, expired): how many observations run out per hour, from their expiry stamps."""
    timed = observations.select(F.col("expires").cast("timestamp").alias("at")).where(F.col("at").isNotNull()).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("expired")).select(F.col("window.start").alias("hour"), "expired")
