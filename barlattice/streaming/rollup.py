"""Streaming extensions: ticks to bars, sessions, duplicates. The same functions serve batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark, for streams; it needs timestamps with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def rollup(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """start, event_type, n, total, open, high, low, close of tumbling windows; `late` sets a watermark for streams."""
    events = timed(events, late)
    order = F.struct("ts", "event_id")
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total", "open", "high", "low", "close")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, start, n of sessions parted by the gap."""
    events = timed(events, late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(news: DataFrame, late: str) -> DataFrame:
    """Streaming rows without repeats of a content hash within the watermark."""
    return news.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])
