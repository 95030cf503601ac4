"""Bar panels and companion series derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickwork.functions.columns import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, idx, open, high, low, close, volume: weekly bars of one integer random walk per supplier."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    w = Window.partitionBy("l_suppkey").orderBy(*order)
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", *order)
    step = (2 * F.col("l_quantity") - 51).cast("long")
    t = t.withColumn("cs", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("seq", F.row_number().over(w))
    cents = F.greatest(10000 + 4 * F.col("cs"), F.lit(100))
    p = t.select(F.col("l_suppkey").cast("long").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("day"), "seq", "l_quantity", cents.alias("cents"))
    price = lambda c: c.cast("double") / 100
    b = p.groupBy("symbol", "day").agg(
        price(F.min_by("cents", "seq")).alias("open"), price(F.max("cents")).alias("high"), price(F.min("cents")).alias("low"),
        price(F.max_by("cents", "seq")).alias("close"), F.sum("l_quantity").alias("volume"))
    return b.withColumn("idx", (F.row_number().over(series("day")) - 1).cast("int"))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, close: an index walk; a week's step comes from the sum of all its orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("day"))
    weekly = o.agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) % 401 - 200).alias("step"))
    return weekly.select("day", (F.greatest(20000 + 2 * F.sum("step").over(Window.orderBy("day")), F.lit(100)).cast("double") / 100).alias("close"))


def vol_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, close: a volatility level from discounts."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("day")).agg(
        ((4 * F.sum(F.round(F.col("l_discount") * 100).cast("long"))).cast("double") / F.count("*")).alias("close"))


def membership_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("symbol"))
    s = s.withColumn("year", F.explode(F.sequence(F.lit(1996), F.lit(2001))))
    return s.filter("(symbol * 7 + year) % 10 <> 0").select(F.make_date("year", F.lit(1), F.lit(1)).alias("snapshot_date"), "symbol")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars before cleaning: an adjusted close, and holes in the newest bar of some symbols."""
    b = bars(spark, sf_dir)
    newest = F.col("idx") == F.max("idx").over(Window.partitionBy("symbol"))
    b = b.withColumn("newest", newest).withColumn("adj_close", F.when(~newest, F.col("close") * (1 - 0.02 * (F.col("symbol") % 3))))
    no_close, no_prices = newest & (F.col("symbol") % 7 == 0), newest & (F.col("symbol") % 11 == 0)
    for c in ("open", "high", "low", "close"):
        b = b.withColumn(c, F.when(no_prices | (no_close if c == "close" else F.lit(False)), None).otherwise(F.col(c)))
    return b.drop("newest", "idx")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, price, traded_at, tz: last trades of the symbols that lack a close."""
    last = bars(spark, sf_dir).filter("symbol % 7 = 0").groupBy("symbol").agg(F.max("day").alias("day"), F.max_by("close", "idx").alias("price"))
    day = F.when(F.col("symbol") % 14 == 0, F.date_sub("day", 1)).otherwise(F.col("day"))
    return last.select("symbol", "price", (day.cast("timestamp") + F.expr("INTERVAL 21 HOURS")).alias("traded_at"), F.lit("America/New_York").alias("tz"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, quantity: single trades, as a stream source would give them."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_suppkey").cast("long").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"))
