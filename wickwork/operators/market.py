"""Market context: breadth of the universe, an index regime, a volatility level, and their as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.columns import exact_mean, r

SERIES = ("regime", "vix", "breadth", "breadth_symbols", "index_close", "index_vs_sma200_pct", "index_sma50_vs_sma200_pct")


def breadth(e: DataFrame) -> DataFrame:
    """day, breadth_symbols, breadth: the share of symbols above their own SMA200 among those that have one."""
    valid = F.col("sma200").isNotNull()
    n, up = F.count_if(valid), F.count_if(valid & (F.col("close") > F.col("sma200")))
    return e.groupBy("day").agg(n.alias("breadth_symbols"), F.when(n > 0, r(up / n, 4)).alias("breadth"))


def regime(index: DataFrame) -> DataFrame:
    """day, index_close, the index against its averages in percent, and regime; one row per index day.

    An index is one series, so its window is one partition by nature.
    """
    w = Window.orderBy("day")
    full = lambda n: F.when(F.count("close").over(w.rowsBetween(1 - n, 0)) == n, exact_mean("close", w.rowsBetween(1 - n, 0)))
    c, s50, s200 = F.col("close"), F.col("s50"), F.col("s200")
    state = F.when(s200.isNull(), None).when((c > s200) & (s50 > s200), "bull").when((c < s200) & (s50 < s200), "bear").otherwise("neutral")
    i = index.withColumn("s50", full(50)).withColumn("s200", full(200))
    return i.select("day", r(c, 2).alias("index_close"), r((c / s200 - 1) * 100, 2).alias("index_vs_sma200_pct"), r((s50 / s200 - 1) * 100, 2).alias("index_sma50_vs_sma200_pct"), state.alias("regime"))


def market_series(e: DataFrame, index: DataFrame, vol: DataFrame) -> DataFrame:
    """One row per day that any of the three series has."""
    return breadth(e).join(regime(index), "day", "full_outer").join(vol.select("day", r(F.col("close"), 2).alias("vix")), "day", "full_outer")


def as_of(rows: DataFrame, day: str, market: DataFrame, columns=SERIES) -> DataFrame:
    """``rows`` with the last value of each market series on or before ``day``; each series has its own last date.

    The market has one row per day, far fewer than the rows: the days are filled forward once and joined by day.
    """
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = rows.select(F.col(day).alias("day")).distinct().join(market, "day", "full_outer")
    filled = days.select("day", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return rows.join(filled.withColumnRenamed("day", "_day"), F.col(day) == F.col("_day"), "left").drop("_day")


def memberships(snapshots: DataFrame) -> DataFrame:
    """(valid_from, valid_to, snapshot_date): the snapshot in force; the first one also before its date."""
    w = Window.orderBy("snapshot_date")
    d = snapshots.select("snapshot_date").distinct()
    first = F.row_number().over(w) == 1
    return d.select("snapshot_date", F.when(first, F.lit("0001-01-01").cast("date")).otherwise(F.col("snapshot_date")).alias("valid_from"),
                    F.coalesce(F.date_sub(F.lead("snapshot_date").over(w), 1), F.lit("9999-12-31").cast("date")).alias("valid_to"))


def intervals(snapshots: DataFrame) -> DataFrame:
    """(symbol, valid_from, valid_to): each stretch of consecutive snapshots that have a symbol, as one row."""
    spans = memberships(snapshots).withColumn("no", F.row_number().over(Window.orderBy("snapshot_date")))
    s = snapshots.select("snapshot_date", "symbol").distinct().join(F.broadcast(spans), "snapshot_date")  # one row per snapshot date
    island = F.col("no") - F.row_number().over(Window.partitionBy("symbol").orderBy("no"))
    return s.withColumn("_i", island).groupBy("symbol", "_i").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).drop("_i")


def only_members(rows: DataFrame, day: str, snapshots: DataFrame) -> DataFrame:
    """The ``rows`` (with symbol) whose symbol was a member on their day: a row meets its symbol's few intervals."""
    i = intervals(snapshots).withColumnRenamed("symbol", "_s")
    return rows.join(i, (F.col("symbol") == F.col("_s")) & F.col(day).between(F.col("valid_from"), F.col("valid_to")), "left_semi")


def members(days: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(day, symbol): who was a member on each day; ``days`` has one row per session."""
    return intervals(snapshots).join(F.broadcast(days), F.col("day").between(F.col("valid_from"), F.col("valid_to"))).select("day", "symbol")
