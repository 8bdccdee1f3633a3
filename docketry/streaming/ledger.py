"""Quotas over a stream of events. The late-data rules are this library's own: events later than the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quota_windows(events: DataFrame, key: str, time: str, *, span: str = "1 hour", slide: str = "1 minute", late: str = "1 day") -> DataFrame:
    """key, window_start, window_end, used: events in each sliding window, which comes out once the watermark has passed it."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = timed.groupBy(F.window(time, span, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("used"))
    return counted.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "used")


def first_deliveries(events: DataFrame, key: list[str], time: str, *, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark; state is kept no longer than that."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, key: str, time: str, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """key, session_start, session_end, n: runs of events less than `gap` apart."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
