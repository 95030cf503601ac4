"""Exact quantiles of groups of any size.

Ranks are found by narrowing: a value of a given rank lies in one of the bins between the least and the greatest value of its
group; counting the bins tells which, and the bin's own least and greatest value are the next range. Each pass sums in every
task before it shuffles, and returns one row for each group, measure and bin. Once a range holds few rows, they are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.sources.store import written

#: Bins of a range, rows that are sorted in one task, and passes before a range's different values are sorted anyway.
BINS, SORTED, PASSES = 1024, 4000, 8


def _reached(counted: DataFrame, state: DataFrame, order: str) -> DataFrame:
    """Of the counted steps of each range, in ``order``, those that hold ranks (ks); ``before`` moves on to the step."""
    w = Window.partitionBy("g", "m", "before").orderBy(order)
    moved = counted.join(state.select("g", "m", "before", "ks"), ["g", "m", "before"]).withColumn("_at", F.col("before") + F.sum("n").over(w) - F.col("n"))
    held = F.filter("ks", lambda k: (k >= F.col("_at")) & (k < F.col("_at") + F.col("n")))
    return moved.withColumn("ks", held).withColumn("before", F.col("_at")).filter("size(ks) > 0")


def quantiles(rows: DataFrame, by: tuple[str, ...], measures: dict[str, tuple[Column, float]], sorted_rows: int = SORTED, bins: int = BINS) -> DataFrame:
    """One row for each group of ``rows``: ``by`` and, for each name in ``measures`` (a column of numbers and a point between
    0 and 1), the value at that point of the group's ordered numbers, between neighbours in proportion; null without any.

    Nulls and NaN do not count. ``by`` may be empty (one row), and its columns may be null. ``rows`` are read once a pass, so
    they should be a table and not a long plan.
    """
    g = F.xxhash64(*by, *[F.col(b).isNull() for b in by]) if by else F.lit(0).cast("long")
    one = [F.struct(F.lit(i).alias("m"), F.lit(float(p)).alias("p"), F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias("v")) for i, (c, p) in enumerate(measures.values())]
    kept = rows.select(g.alias("g"), *by, F.array(*one).alias("x"))
    values = kept.select("g", F.explode("x").alias("x")).select("g", "x.m", "x.p", "x.v").filter("v is not null")
    # Both neighbours of a point are ranks; a range is where some of them lie: the values before it and in it.
    at = (F.col("n") - 1) * F.col("p")
    whole = values.groupBy("g", "m", "p").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    whole = written(whole.withColumn("share", at - F.floor(at)).withColumn("ks", F.array_distinct(F.array(F.floor(at), F.ceil(at)))).drop("p"))
    state = whole.select("g", "m", F.lit(0).cast("long").alias("before"), "n", "lo", "hi", "ks")
    values = values.drop("p")

    def inside() -> DataFrame:
        return values.join(state.filter("lo < hi").select("g", "m", "before", "lo", "hi"), ["g", "m"]).filter("v between lo and hi")

    for _ in range(PASSES):
        if state.filter((F.col("lo") < F.col("hi")) & (F.col("n") > sorted_rows)).isEmpty():
            break
        # Halved, so that a range as wide as all doubles does not overflow.
        place = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2) * bins
        bin_ = F.when(F.col("v") == F.col("lo"), 0).when((F.col("v") == F.col("hi")) | place.isNull() | F.isnan(place), bins - 1).otherwise(F.least(F.floor(place), F.lit(bins - 1)))
        counted = inside().groupBy("g", "m", "before", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        state = written(state.filter("lo = hi").unionByName(_reached(counted, state, "bin").select(*state.columns)))
    different = inside().groupBy("g", "m", "before", "v").agg(F.count("*").alias("n"))
    found = _reached(different, state, "v").select("g", "m", "v", "ks").unionByName(state.filter("lo = hi").select("g", "m", F.col("lo").alias("v"), "ks"))
    found = found.select("g", "m", "v", F.explode("ks").alias("k")).join(whole.select("g", "m", "share"), ["g", "m"])
    a, b = F.min_by("v", "k"), F.max_by("v", "k")
    points = found.groupBy("g", "m").agg((a + (b - a) * F.max("share")).alias("q"))
    wide = points.groupBy("g").agg(*[F.max(F.when(F.col("m") == i, F.col("q"))).alias(name) for i, name in enumerate(measures)])
    groups = kept.select("g", *by).distinct() if by else kept.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"))
    return groups.join(wide, "g", "left").drop("g")
