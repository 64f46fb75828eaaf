"""Event-time windows. Every function takes a batch or a streaming DataFrame; streams get a watermark.

Defined edge cases: null times are in no window; late events beyond the watermark
are dropped by streams and kept by batches; empty inputs give no windows; with a
session gap of g, events exactly g apart are in one session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Events with ``at``, a zoned event time, and a watermark on streams."""
    rows = events.where(F.col(time).isNotNull()).withColumn("at", F.col(time).cast("timestamp"))
    return rows.withWatermark("at", delay) if events.isStreaming else rows


def sessions(events: DataFrame, key: str, item: str, time: str = "ts", gap: str = "2 seconds", delay: str = "1 hour") -> DataFrame:
    """Debounced batches: ``key, start, end, n, items``; a session ends when ``gap`` passes without an event.

    Sessions are merged in partial aggregation before the shuffle. ``items`` are distinct and sorted.
    """
    grouped = timed(events, time, delay).groupBy(F.session_window("at", gap).alias("w"), key)
    made = grouped.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(item)), ",").alias("items"))
    return made.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "items")


def tumbling(events: DataFrame, by: list[str], value: str, time: str = "ts", size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``start, by..., n, total`` per window of fixed size."""
    grouped = timed(events, time, delay).groupBy(F.window("at", size).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, by: list[str], value: str, time: str = "ts", size: str = "7 days", slide: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """As ``tumbling``, with windows of ``size`` that start every ``slide``."""
    grouped = timed(events, time, delay).groupBy(F.window("at", size, slide).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")
