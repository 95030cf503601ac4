"""Cleaning raw bars: adjustment, late closes, holes, alignment of the last bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def symbols(text: DataFrame) -> DataFrame:
    """Distinct symbols of a text column ``symbol``: trimmed, upper case, dots as dashes; empty and NAN go."""
    s = F.upper(F.regexp_replace(F.trim("symbol"), r"\.", "-"))
    return text.select(s.alias("symbol")).filter("symbol is not null and symbol <> '' and symbol <> 'NAN'").distinct()


def adjust_ohlc(raw: DataFrame) -> DataFrame:
    """Prices times adjusted over raw close; a missing ratio is 1, volume stays."""
    ratio = F.coalesce(F.try_divide("adj_close", "close"), F.lit(1.0))
    return raw.withColumn("_ratio", ratio).withColumns({c: F.col(c) * F.col("_ratio") for c in PRICES}).drop("_ratio")


def as_utc(c: Column) -> Column:
    """A timestamp from epoch seconds as text, or from a timestamp text."""
    t = F.trim(c)
    return F.when(t.rlike(r"^-?\d+$"), F.timestamp_seconds(t.try_cast("bigint"))).otherwise(F.try_to_timestamp(t))


def fill_missing_close(raw: DataFrame, quotes: DataFrame, now: Column, least_age: str = "INTERVAL 1 HOUR") -> DataFrame:
    """``raw`` with the newest row's missing close taken from the last trade, if that was on the row's day in the exchange's
    time zone, is positive and at least ``least_age`` old; ``filled`` marks such rows."""
    newest = F.col("day") == F.max("day").over(Window.partitionBy("symbol"))
    q = quotes.select("symbol", "price", "traded_at", "tz")
    j = raw.withColumn("_newest", newest).join(q, "symbol", "left")
    ok = F.col("_newest") & F.col("close").isNull() & (F.col("price") > 0) & (F.to_date(F.from_utc_timestamp("traded_at", F.col("tz"))) == F.col("day")) & (now - F.expr(least_age) >= F.col("traded_at"))
    j = j.withColumn("filled", F.coalesce(ok, F.lit(False)))
    use = lambda c, v: F.when(F.col("filled"), v).otherwise(F.col(c))
    price = F.col("price")
    return (j.withColumn("close", use("close", price)).withColumn("high", use("high", F.greatest("high", price))).withColumn("low", use("low", F.least("low", price)))
            .withColumn("open", use("open", F.coalesce("open", price))).withColumn("adj_close", use("adj_close", F.coalesce("adj_close", price))).drop("_newest", "price", "traded_at", "tz"))


def partial_bars(raw: DataFrame) -> DataFrame:
    """symbol, last_ok, partial: days after the last close that have any value."""
    last = F.max(F.when(F.col("close").isNotNull(), F.col("day"))).over(Window.partitionBy("symbol"))
    some = F.coalesce(*[F.col(c) for c in (*PRICES, "volume")]).isNotNull()
    r = raw.withColumn("last_ok", last).filter("last_ok is not null")
    return r.groupBy("symbol", "last_ok").agg(F.array_sort(F.collect_list(F.when((F.col("day") > F.col("last_ok")) & some, F.col("day").cast("string")))).alias("partial"))


def complete(raw: DataFrame, least: int = 60) -> DataFrame:
    """Rows with a close, of symbols that have at least ``least`` of them, numbered by idx."""
    w = Window.partitionBy("symbol")
    c = raw.filter("close is not null").withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least).drop("_n")
    return c.withColumn("idx", (F.row_number().over(w.orderBy("day")) - 1).cast("int"))


def histogram(bars: DataFrame) -> DataFrame:
    """day, symbols: how many symbols have their newest bar on it."""
    return bars.groupBy("symbol").agg(F.max("day").alias("day")).groupBy("day").agg(F.count("*").alias("symbols"))


def last_bar(bars: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: the newest day on or after which at least ``share`` of the symbols have their newest bar."""
    h = histogram(bars)
    reached = h.withColumn("cum", F.sum("symbols").over(Window.orderBy(F.desc("day")))).crossJoin(h.agg(F.sum("symbols").alias("n")))
    return reached.filter(F.col("cum") >= share * F.col("n")).agg(F.max("day").alias("last_bar"))


def align(bars: DataFrame, share: float = 0.5, least: int = 60) -> DataFrame:
    """``bars`` up to the last bar; leaders that fall short of ``least`` bars by that go, laggards stay."""
    b = bars.crossJoin(F.broadcast(last_bar(bars, share)))  # one row
    w = Window.partitionBy("symbol")
    b = b.withColumn("_ahead", F.max("day").over(w) > F.col("last_bar")).filter("day <= last_bar").withColumn("_n", F.count("*").over(w))
    return b.filter(~F.col("_ahead") | (F.col("_n") >= least)).drop("_ahead", "_n", "last_bar")


def align_info(bars: DataFrame, partial: DataFrame, share: float = 0.5, least: int = 60) -> DataFrame:
    """One row: last_bar, symbols on it, symbols behind it, and what was skipped after it."""
    last = last_bar(bars, share)
    kept = align(bars, share, least).groupBy("symbol").agg(F.max("day").alias("day")).crossJoin(F.broadcast(last))
    counts = kept.agg(F.count_if(F.col("day") == F.col("last_bar")).alias("last_bar_symbols"), F.count_if(F.col("day") < F.col("last_bar")).alias("lagging_symbols"))
    ahead = bars.crossJoin(F.broadcast(last)).filter("day > last_bar").select("day", F.lit(1).alias("whole"))
    half = partial.select(F.explode("partial").alias("day")).withColumn("day", F.col("day").cast("date")).crossJoin(F.broadcast(last)).filter("day > last_bar").select("day", F.lit(0).alias("whole"))
    skipped = ahead.unionByName(half).groupBy("day").agg(F.sum("whole").alias("c"), F.sum(1 - F.col("whole")).alias("p"))
    newest = skipped.agg(F.max(F.struct("day", "c", "p")).alias("s")).select(F.col("s.day").alias("skipped_bar"), F.coalesce("s.c", F.lit(0)).alias("skipped_bar_complete"), F.coalesce("s.p", F.lit(0)).alias("skipped_bar_partial"))
    return last.crossJoin(counts).crossJoin(newest)


def null_profile(raw: DataFrame) -> DataFrame:
    """symbol, raw_last, missing (columns without a value in the newest row), last_ok."""
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (*PRICES, "volume")])), ",")
    return raw.groupBy("symbol").agg(F.max("day").alias("raw_last"), F.max_by(names, "day").alias("missing"), F.max(F.when(F.col("close").isNotNull(), F.col("day"))).alias("last_ok"))


def session_cutoff(now: Column) -> Column:
    """The last day whose bar is whole at ``now`` (UTC): today from 21:00 on, else yesterday."""
    return F.when(F.hour(now) >= 21, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))
