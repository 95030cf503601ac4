"""Bars from a stream of trades: tumbling windows with a watermark, and sessions of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(trades: DataFrame, every: str = "7 days", late: str = "7 days") -> DataFrame:
    """symbol, start, open, high, low, close, volume per window; trades later than ``late`` are not waited for.

    Works on a batch table and on a stream alike: the watermark has no effect on a batch.
    """
    t = trades.withWatermark("ts", late)
    first, last = F.min_by("price", F.struct("ts", "price")), F.max_by("price", F.struct("ts", "price"))
    return t.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), F.sum("quantity").alias("volume")).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def sessions(trades: DataFrame, gap: str = "5 days", late: str = "7 days") -> DataFrame:
    """symbol, start, end, trades per run of trades with no longer gap than ``gap``."""
    t = trades.withWatermark("ts", late)
    return t.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("trades")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "trades")
