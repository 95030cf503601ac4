"""What became of positions: fills, first hits, excursions, variants, and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.columns import r
from wickwork.functions.rules import CUP
from wickwork.operators.quantiles import quantiles
from wickwork.sources.store import written

TRADED = ("target", "stop", "open")
KEY = ("symbol", "d", "pattern", "stop")
SCORE_BUCKETS = ((60, 69), (70, 79), (80, 89), (90, 100))
HORIZONS = (5, 10, 20, 40, 60)
#: Inner right-inclusive edges of the feature buckets.
FEATURE_EDGES = {
    "volume_ratio": (0.8, 1.0, 1.3, 2.0), "close_vs_sma200": (-0.05, 0.0, 0.10, 0.25), "sma50_vs_sma200": (-0.05, 0.0, 0.05), "sma200_slope": (-0.02, 0.0, 0.02, 0.05),
    "dist_sma200_atr": (-2.0, 0.0, 3.0, 6.0), "stop_atr": (1.5, 3.0, 5.0), "risk_pct": (4.0, 8.0, 12.0), "reward_risk": (1.5, 2.5, 4.0), "wait_bars": (10, 20, 40, 60), "bars_since_break": (0, 1, 3, 8),
    "vix": (15.0, 20.0, 25.0), "breadth": (0.4, 0.55, 0.7), "depth_atr": (3.0, 6.0, 10.0), "break_close_pos": (0.5, 0.8), "break_over_prior_high": (0.5,), "volume_z": (0.0, 1.5, 3.0),
    "handle_volume_ratio": (0.7, 1.0), "handle_volume_slope": (0.0,), "fg_score": (20.0, 40.0, 60.0, 80.0), "fg_base": (20.0, 40.0, 60.0, 80.0), "fg_rsi": (30.0, 50.0, 70.0), "fg_bb_pctb": (0.0, 0.5, 1.0),
    "fg_macd_pct": (20.0, 50.0, 80.0),
}


#: Least bars of a block of paths.
BLOCK = 64


#: What a path has of each bar, as arrays of its own.
PATH = ("day", "open", "high", "low", "close")


def paths(rows: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """``rows`` (symbol, d, ...) with path: the ``horizon`` bars after bar d as a struct of arrays in order (day, open, high,
    low, close), empty if there are none.

    A symbol's bars are numbered without gaps. A block of bars and the ``horizon`` after it are one row of arrays, so a row
    meets exactly one of them, by equality of symbol and block, and its path is a slice: no range join, nothing to group.
    """
    size = max(BLOCK, horizon)
    within = F.sequence(F.greatest(F.floor((F.col("idx") - horizon) / size), F.lit(0)), F.floor((F.col("idx") - 1) / size))
    b = bars.filter("idx > 0").select("symbol", F.struct("idx", *PATH).alias("bar"), F.explode(within).alias("_block")).groupBy("symbol", "_block").agg(F.sort_array(F.collect_list("bar")).alias("bars"))
    b = b.select("symbol", "_block", *[F.col(f"bars.{c}").alias(f"_{c}") for c in PATH])
    out = rows.withColumn("_block", F.floor(F.col("d") / size)).join(b, ["symbol", "_block"], "left")
    # The arrays start with the bar after the block's first.
    part = lambda c: F.slice(F.coalesce(f"_{c}", F.array().cast(b.schema[f"_{c}"].dataType)), (F.col("d") - F.col("_block") * size + 1).cast("int"), horizon)
    return out.select(*rows.columns, F.struct(*[part(c).alias(c) for c in PATH]).alias("path"))


def with_paths(rows: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """``rows`` with their paths; those that have some keep them."""
    return rows if "path" in rows.columns else paths(rows, bars, horizon)


def first(values: str, holds) -> Column:
    """The place, from 1, of the first of ``values`` of a path for which ``holds``; 0 without one."""
    return F.array_position(F.transform(f"path.{values}", holds), True).cast("int")


def at(place: Column, values: str) -> Column:
    """One of ``values`` of a path by its place, from 1; null beyond it."""
    return F.get(f"path.{values}", place - 1)


def seen() -> Column:
    """The number of bars of a path."""
    return F.size("path.close")


def _meets(at_stop: Column, at_target: Column) -> tuple[Column, Column]:
    """Whether the stop comes first (with the target it does), and the place of what comes first, 0 if neither."""
    stopped = (at_stop > 0) & ((at_target == 0) | (at_stop <= at_target))
    return stopped, F.when(stopped, at_stop).otherwise(at_target)


def _exit(stopped: Column, hit: Column, stop: Column, target: Column, at_close: Column) -> Column:
    """The price at the first hit, beyond a level at the open; the last close without a hit."""
    return (F.when(hit == 0, at(seen(), "close")).when(~stopped, F.greatest(at(hit, "open"), target))
            .when(at_close, at(hit, "close")).otherwise(F.least(at(hit, "open"), stop)))


def resolve(rows: DataFrame, bars: DataFrame, horizon: int = 40, fill: Column | None = None, close_basis: bool = False) -> DataFrame:
    """``rows`` with fill, outcome (no_data, stop, target, open), bars, exit, r, and fill and exit days, and n, the bars seen.

    A bar that touches both levels is a stop. Gaps beyond a level fill at the open. Without ``fill`` the next open is it.
    With ``close_basis`` only a close at or below the stop ends a position.
    """
    g = with_paths(rows, bars, horizon)
    stop, target = F.col("stop"), F.col("target")
    g = g.withColumn("_s", first("close" if close_basis else "low", lambda x: x <= stop)).withColumn("_t", first("high", lambda x: x >= target))
    stopped, hit = _meets(F.col("_s"), F.col("_t"))
    g = g.withColumn("_hit", hit).withColumn("_stopped", stopped).withColumn("n", seen())
    hit, stopped, one = F.col("_hit"), F.col("_stopped"), F.lit(1)
    g = g.withColumn("fill", at(one, "open") if fill is None else fill).withColumn("exit", _exit(stopped, hit, stop, target, F.lit(close_basis)))
    g = g.withColumn("outcome", F.when(F.col("n") == 0, "no_data").when(hit == 0, "open").when(stopped, "stop").otherwise("target"))
    g = g.withColumn("bars", F.when(hit == 0, F.col("n")).otherwise(hit)).withColumn("r", F.when(F.col("fill") > stop, (F.col("exit") - F.col("fill")) / (F.col("fill") - stop)))
    g = g.withColumn("fill_day", at(one, "day")).withColumn("exit_day", at(F.col("bars"), "day"))
    return g.select(*rows.columns, "fill", "outcome", "bars", "exit", "r", "fill_day", "exit_day", "n")


def fill_and_resolve(rows: DataFrame, bars: DataFrame, horizon=40, expire: bool = False) -> DataFrame:
    """:func:`resolve` under the report's rules: an open above ``max_buy`` is a gap, one at or below the stop is below_stop;
    with ``expire`` an unresolved position of a whole horizon is expired."""
    g = resolve(rows, bars, horizon)
    gap, low = F.col("fill") > F.coalesce("max_buy", F.col("entry") * 1.05), F.col("fill") <= F.col("stop")
    outcome = F.when(F.col("outcome") == "no_data", "no_data").when(gap, "gap").when(low, "below_stop")
    if expire:
        outcome = outcome.when((F.col("outcome") == "open") & (F.col("n") >= horizon), "expired")
    g = g.withColumn("outcome", F.coalesce(outcome, "outcome"))
    held = F.col("outcome").isin(*TRADED, "expired")
    for c in ("exit", "r", "exit_day"):
        g = g.withColumn(c, F.when(held, F.col(c)))
    return g.withColumn("bars", F.when(held, F.col("bars")).otherwise(0)).drop("n")


def excursions(rows: DataFrame, bars: DataFrame, horizon=40) -> DataFrame:
    """``rows`` (with fill and stop) with mfe, mae and success5: whether +5 % came before a close below the stop."""
    up, down = first("high", lambda x: x >= F.col("fill") * 1.05), first("close", lambda x: x < F.col("stop"))
    g = with_paths(rows, bars, horizon).withColumn("_u", up).withColumn("_d", down)
    good = F.when((F.col("_u") > 0) & ((F.col("_d") == 0) | (F.col("_u") <= F.col("_d"))), True).when(F.col("_d") > 0, False)
    g = g.withColumn("mfe", r(F.array_max("path.high") / F.col("fill") - 1, 4)).withColumn("mae", r(F.array_min("path.low") / F.col("fill") - 1, 4))
    return g.withColumn("success5", good).select(*rows.columns, "mfe", "mae", "success5")


def scored(rows: DataFrame, bars: DataFrame, horizon: int = 40) -> DataFrame:
    """``rows`` bought at the next open, with outcome and, where traded, excursions; both walk one path."""
    f = excursions(fill_and_resolve(paths(rows, bars, horizon), bars, horizon), bars, horizon).drop("path")
    return f.withColumns({c: F.when(F.col("r").isNotNull(), F.col(c)) for c in ("mfe", "mae", "success5")})


def counts() -> list[Column]:
    names = ("target", "stop", "open", "expired", "gap", "below_stop", "no_data")
    return [F.count("*").alias("n"), *[F.count_if(F.col("outcome") == x).alias(x) for x in names]]


def traded_r() -> Column:
    return F.when(F.col("outcome").isin(*TRADED), F.col("r"))


def hit_rate() -> Column:
    t, s = F.count_if(F.col("outcome") == "target"), F.count_if(F.col("outcome") == "stop")
    return F.when(t + s > 0, r(t / (t + s), 3))


def summary() -> list[Column]:
    """Counts, hit rate, mean and total R over traded rows."""
    return [*counts(), hit_rate().alias("hit_rate"), r(F.avg(traded_r()), 3).alias("mean_r"), r(F.sum(traded_r()), 2).alias("total_r")]


def statistics() -> list[Column]:
    """What :func:`described` returns, but for the median."""
    x = traded_r()
    traded = F.col("outcome").isin(*TRADED)
    # Excursions have four decimals: summed as whole numbers, their mean is the same in any order.
    whole = lambda c: F.sum(F.when(traded, F.round(F.col(c) * 1e4).cast("long"))).cast("double") / (F.count(F.when(traded, F.col(c))) * 1e4)
    return [F.count("*").alias("signals"), *counts()[1:], hit_rate().alias("hit_rate"), r(F.avg(x), 3).alias("mean_r"), r(F.stddev_samp(x), 3).alias("std_r"), r(F.sum(x), 2).alias("total_r"),
            r(F.avg(F.when(traded, F.col("success5").cast("double"))), 3).alias("success5"), r(whole("mfe"), 4).alias("mfe"), r(whole("mae"), 4).alias("mae")]


def described(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Statistics of each group of ``rows``, with the exact median R of its traded ones."""
    rows = written(rows.select(*by, "outcome", "r", "success5", "mfe", "mae"))
    middle = quantiles(rows, by, {"median_r": (traded_r(), 0.5)}).withColumn("median_r", r(F.col("median_r"), 3))
    stats = rows.groupBy(*by).agg(*statistics())
    middle = middle.withColumnsRenamed({c: f"_{c}" for c in by})
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    return stats.join(middle, match).select(*stats.columns, "median_r")


def reported(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """:func:`described` with the deepest drawdown of the groups' traded rows by scan_day and ``order``, and the month
    bootstrap of their mean and drawdown; the columns of ``by`` are not null."""
    rows = written(rows.select(*by, "scan_day", *order, "outcome", "r", "success5", "mfe", "mae"))
    traded = rows.filter("r is not null")
    out = described(rows, by).join(drawdown(traded, by, "scan_day", order), list(by), "left")
    return out.join(month_bootstrap(traded, by, order=("scan_day", *order)).drop("blocks"), list(by), "left")


def slices(rows: DataFrame) -> DataFrame:
    """``rows`` once for each slice they are in: kind and slice, for all, the pattern, the score bucket and the regime."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("slice"))
    every = F.array(one("overall", F.lit("all")), one("pattern", F.col("pattern")), one("score", score_bucket()), one("regime", F.col("regime")))
    return rows.withColumn("_s", F.explode(every)).filter("_s.slice is not null").withColumn("kind", F.col("_s.kind")).withColumn("slice", F.col("_s.slice")).drop("_s")


def score_bucket() -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in SCORE_BUCKETS:
        out = F.when(F.col("score").between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out


def breakdown(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics overall, by pattern, by score bucket and by regime: kind, slice, ...; apart for each ``by``."""
    return described(slices(rows), (*by, "kind", "slice"))


def running(rows: DataFrame, by: tuple[str, ...], day: str, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with cum and peak: the running sum of r in each ``by``, over days and within a day in ``order``, and its
    highest value so far, which starts at 0.

    Days are summed first; only they go through a window of a whole ``by``, rows through one of their day.
    """
    inside = Window.partitionBy(*by, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("_in", F.sum(F.coalesce("r", F.lit(0.0))).over(inside))
    x = x.withColumn("_top", F.max("_in").over(inside))
    earlier = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = x.groupBy(*by, day).agg(F.sum("r").alias("_sum"), F.max("_in").alias("_max"))
    days = days.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    days = days.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_before") + F.col("_max")).over(earlier), F.lit(0.0)), F.lit(0.0))).drop("_sum", "_max")
    x = x.join(days, [*by, day])
    return (x.withColumn("cum", F.col("_before") + F.col("_in")).withColumn("peak", F.greatest("_peak", F.col("_before") + F.col("_top")))
            .drop("_in", "_top", "_before", "_peak"))


def drawdown(rows: DataFrame, by: tuple[str, ...], day: str, order: tuple[str, ...]) -> DataFrame:
    """max_dd: the deepest fall of the cumulative R curve from its peak, which starts at 0.

    The fall is that of :func:`running`, but a day is summed up first (its sum, the highest, the lowest and the deepest fall
    of its running sum), so ``rows`` are read once and only days go on. Rows without r leave the curve as it is: a caller need
    not filter them, which would repeat all that r comes from in the condition.
    """
    inside = Window.partitionBy(*by, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("_in", F.sum(F.coalesce("r", F.lit(0.0))).over(inside))
    x = x.withColumn("_top", F.max("_in").over(inside))
    days = x.groupBy(*by, day).agg(F.sum("r").alias("_sum"), F.max("_in").alias("_max"), F.min("_in").alias("_low"), F.min(F.col("_in") - F.col("_top")).alias("_fall"), F.count("r").alias("_n")).filter("_n > 0")
    earlier = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    days = days.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_before") + F.col("_max")).over(earlier), F.lit(0.0)), F.lit(0.0)))
    deepest = F.min(F.least(F.col("_before") + F.col("_low") - F.col("_peak"), F.col("_fall")))
    return days.groupBy(*by).agg(r(deepest, 3).alias("max_dd"))


def month_bootstrap(rows: DataFrame, by: tuple[str, ...], replicates: int = 2000, seed: int = 0, order: tuple[str, ...] = ("scan_day", "symbol")) -> DataFrame:
    """ci_low, ci_high, dd_p95, blocks: the mean R, and the drawdown of the trades in ``order``, when months are drawn with
    replacement.

    A month is summed up first (its sum, its number, the highest, the lowest and the deepest fall of its running sum), so a
    replicate joins few rows; a draw is the first 8 hex digits of md5(seed-replicate-position) modulo the months. Under 2
    months or 5 trades there is no interval.
    """
    t = rows.filter("r is not null").withColumn("month", F.date_format("scan_day", "yyyy-MM"))
    inside = Window.partitionBy(*by, "month").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_in", F.sum("r").over(inside)).withColumn("_top", F.max("_in").over(inside))
    m = t.groupBy(*by, "month").agg(F.sum("r").alias("s"), F.count("*").alias("k"), F.max("_in").alias("top"), F.min("_in").alias("low"), F.min(F.col("_in") - F.col("_top")).alias("fall"))
    w = Window.partitionBy(*by)
    m = m.withColumn("at", F.row_number().over(w.orderBy("month")) - 1).withColumn("blocks", F.count("*").over(w)).withColumn("trades", F.sum("k").over(w))
    draws = (m.select(*by, "blocks").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("pos", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))))
    text = F.md5(F.concat_ws("-", F.lit(str(seed)), "rep", "pos").cast("binary"))
    draws = draws.withColumn("at", F.conv(F.substring(text, 1, 8), 16, 10).cast("long") % F.col("blocks")).drop("blocks")
    before = Window.partitionBy(*by, "rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    drawn = draws.join(m.drop("month"), [*by, "at"]).withColumn("_sum", F.coalesce(F.sum("s").over(before), F.lit(0.0)))
    drawn = drawn.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_sum") + F.col("top")).over(before), F.lit(0.0)), F.lit(0.0)))
    deepest = F.min(F.least(F.col("_sum") + F.col("low") - F.col("_peak"), F.col("fall")))
    means = drawn.groupBy(*by, "blocks", "trades", "rep").agg((F.sum("s") / F.sum("k")).alias("mean"), deepest.alias("dd"))
    enough = (F.col("blocks") >= 2) & (F.col("trades") >= 5)
    share = lambda c, p: F.percentile(c, p)
    return (means.groupBy(*by, "blocks", "trades").agg(share("mean", 0.025).alias("l"), share("mean", 0.975).alias("h"), share("dd", 0.05).alias("d"))
            .select(*by, *[F.when(enough, r(F.col(c), 3)).alias(n) for c, n in (("l", "ci_low"), ("h", "ci_high"), ("d", "dd_p95"))], "blocks"))


#: The grid's stop extras in ATR, stop bases and target modes.
EXTRAS, BASES, MODES = (0.0, 0.25, 0.75, 1.0), ("intraday", "close"), ("full", "half", "breakout")


def grid(rows: DataFrame, bars: DataFrame, horizon: int = 40, by: tuple[str, ...] = ()) -> DataFrame:
    """Traded ``rows`` scored again under every variant: extra, basis, mode and their summary, apart for each ``by``.

    A path is searched once for each of the eight stops and once for each of the three targets: what each leaves is a place
    and the price of an exit there, and a variant compares a stop's with a target's.
    """
    v = rows.filter(F.col("outcome").isin(*TRADED)).select("symbol", "d", "pattern", "stop", "target", "atr", "fill", "cup_bottom", "cup_trigger", *by)
    v = paths(v, bars, horizon).filter(seen() > 0)
    fill = F.col("fill")
    cup = (F.col("pattern") == CUP) & F.col("cup_bottom").isNotNull()
    targets = {"full": F.col("target"), "half": fill + 0.5 * (F.col("target") - fill), "breakout": F.when(cup, fill + (F.col("cup_trigger") - F.col("cup_bottom"))).otherwise(F.col("target"))}
    v = v.withColumns({f"_t_{m}": F.when(F.col("target").isNotNull(), t) for m, t in targets.items()} | {f"_s_{i}": F.col("stop") - x * F.col("atr") for i, x in enumerate(EXTRAS)})
    for m in MODES:
        v = v.withColumn(f"_at_{m}", first("high", lambda x: x >= F.col(f"_t_{m}")))
    for i in range(len(EXTRAS)):
        for b in BASES:
            v = v.withColumn(f"_at_{i}_{b}", first("close" if b == "close" else "low", lambda x: x <= F.col(f"_s_{i}")))
    ends = [F.struct(F.lit(m).alias("mode"), F.col(f"_at_{m}").alias("place"), F.greatest(at(F.col(f"_at_{m}"), "open"), F.col(f"_t_{m}")).alias("exit")) for m in MODES]
    falls = []
    for i, x in enumerate(EXTRAS):
        for b in BASES:
            place, stop = F.col(f"_at_{i}_{b}"), F.col(f"_s_{i}")
            price = at(place, "close") if b == "close" else F.least(at(place, "open"), stop)
            falls.append(F.struct(F.lit(x).alias("extra"), F.lit(b).alias("basis"), place.alias("place"), stop.alias("stop"), price.alias("exit")))
    v = v.select(*by, "fill", at(seen(), "close").alias("last"), F.array(*ends).alias("ends"), F.explode(F.array(*falls)).alias("s")).select(*by, "fill", "last", "s", F.explode("ends").alias("t"))
    stopped, hit = _meets(F.col("s.place"), F.col("t.place"))
    exit_ = F.when(hit == 0, F.col("last")).when(stopped, F.col("s.exit")).otherwise(F.col("t.exit"))
    v = v.withColumn("outcome", F.when(hit == 0, "open").when(stopped, "stop").otherwise("target")).withColumn("r", F.when(fill > F.col("s.stop"), (exit_ - fill) / (fill - F.col("s.stop"))))
    return v.groupBy(*by, "s.extra", "s.basis", "t.mode").agg(*summary())


def horizon_table(rows: DataFrame, bars: DataFrame, horizons=HORIZONS, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact median excursions and outcome shares by horizon, overall and per pattern, apart for each ``by``; one path a row,
    to the longest."""
    t = paths(rows.filter(F.col("outcome").isin(*TRADED)).select("symbol", "d", "pattern", "stop", "target", "atr", "fill", *by), bars, max(horizons)).filter(seen() > 0)
    t = t.withColumn("_s", first("low", lambda x: x <= F.col("stop"))).withColumn("_t", first("high", lambda x: x >= F.col("target")))
    stopped, hit = _meets(F.col("_s"), F.col("_t"))
    t = t.withColumn("_hit", hit).withColumn("_stopped", stopped)
    out = lambda h: F.when((F.col("_hit") == 0) | (F.col("_hit") > h), "open").when(F.col("_stopped"), "stop").otherwise("target")
    each = [F.struct(F.lit(h).alias("horizon"), out(h).alias("outcome"), F.array_max(F.slice("path.high", 1, h)).alias("hi"), F.array_min(F.slice("path.low", 1, h)).alias("lo")) for h in horizons]
    f = t.select(*by, "fill", "atr", "pattern", F.explode(F.array(*each)).alias("x")).select(*by, "fill", "atr", F.explode(F.array(F.lit("all"), F.col("pattern"))).alias("slice"), "x.*")
    up, down, by = F.col("hi") - F.col("fill"), F.col("lo") - F.col("fill"), (*by, "slice", "horizon")
    f = written(f.select(*by, "outcome", (F.col("hi") / F.col("fill") - 1).alias("up"), (F.col("lo") / F.col("fill") - 1).alias("down"), (up / F.col("atr")).alias("up_atr"), (down / F.col("atr")).alias("down_atr")))
    places = {"median_mfe": ("up", 4), "median_mae": ("down", 4), "median_mfe_atr": ("up_atr", 2), "median_mae_atr": ("down_atr", 2)}
    middle = quantiles(f, by, {k: (F.col(c), 0.5) for k, (c, _) in places.items()}).withColumns({k: r(F.col(k), n) for k, (_, n) in places.items()})
    share = lambda o: r(F.count_if(F.col("outcome") == o) / F.count("*"), 3).alias(o)
    return f.groupBy(*by).agg(F.count("*").alias("n"), share("target"), share("stop"), share("open")).join(middle, list(by))


def feature_buckets(rows: DataFrame, edges: dict[str, tuple[float, ...]]) -> DataFrame:
    """Summaries of the traded rows per feature and right-inclusive bucket (numbered from 0), with the rows that lack it."""
    t = rows.filter(F.col("outcome").isin(*TRADED))
    long = t.select("outcome", "r", F.explode(F.map_from_arrays(F.array(*map(F.lit, edges)), F.array(*[F.col(k).cast("double") for k in edges]))).alias("feature", "value"))
    bucket = F.lit(None).cast("int")
    for key, e in edges.items():
        inner = e[1:-1]
        bucket = F.when(F.col("feature") == key, sum((F.when(F.col("value") > x, 1).otherwise(0) for x in inner), F.lit(0))).otherwise(bucket)
    found = long.withColumn("bucket", F.when(F.col("value").isNotNull(), bucket)).groupBy("feature", "bucket").agg(*summary())
    # Few rows by now: a feature's rows without a value are the bucket null.
    missing = F.coalesce(F.max(F.when(F.col("bucket").isNull(), F.col("n"))).over(Window.partitionBy("feature")), F.lit(0).cast("long"))
    return found.withColumn("missing", missing).filter("bucket is not null")
