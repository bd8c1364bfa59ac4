"""Bars from a stream of ticks: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bars(ticks: DataFrame, period: str = "1 minute", lateness: str = "5 minutes") -> DataFrame:
    """One bar per (symbol, window) of ticks (symbol, ts timestamp, seq, price, size); works on batches as well."""
    order = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", period)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("trade_count"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"),
    )
    return bars.select("symbol", F.col("window.start").alias("timestamp"), "open", "high", "low", "close", "volume", "trade_count", "vwap")
