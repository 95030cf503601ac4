"""Indicators as window columns over bars (symbol, idx, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.columns import TICKS, exact_mean, r, series, trailing, true


def true_range() -> Column:
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def full(aggregate: Column, column: str, frame, n: int) -> Column:
    """A window value that needs all ``n`` values of its frame."""
    return F.when(F.count(column).over(frame) == n, aggregate.over(frame))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("tr", true_range()).withColumn("atr", exact_mean("tr", trailing(n)))


def with_restarted_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr_parts: what atr would be if the series began k - 1 bars earlier, for k = 1 ... n - 1, when its first true range is
    that bar's high less its low."""
    ticks = lambda c: F.round(c * TICKS).cast("long")
    b = bars.withColumn("_t", ticks(F.col("tr"))).withColumn("_f", ticks(F.col("high") - F.col("low")))
    before = lambda c, k: F.lag(c, k).over(series()) if k else F.col(c)
    part = lambda k: sum((before("_t", m) for m in range(k - 1)), before("_f", k - 1)).cast("double") / (k * float(TICKS))
    return b.withColumn("atr_parts", F.array(*[part(k) for k in range(1, n)])).drop("_t", "_f")


def with_smas(bars: DataFrame) -> DataFrame:
    """sma50, sma200: differences of running sums of whole ticks, so a long frame costs no more than a short one."""
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    b = bars.withColumn("_sum", F.sum(F.round(F.col("close") * TICKS).cast("long")).over(so_far)).withColumn("_n", F.count("close").over(so_far))
    since = lambda c, n: F.col(c) - F.coalesce(F.lag(c, n).over(series()), F.lit(0))
    mean = lambda n: F.when(since("_n", n) == n, since("_sum", n).cast("double") / (n * float(TICKS)))
    return b.withColumn("sma50", mean(50)).withColumn("sma200", mean(200)).drop("_sum", "_n")


def with_pivots(bars: DataFrame, order: int = 5) -> DataFrame:
    """piv_h, piv_l: strictly beyond the ``order`` bars before, at least equal to those after, both full."""
    before, after = series().rowsBetween(-order, -1), series().rowsBetween(1, order)
    whole = (F.count("close").over(before) == order) & (F.count("close").over(after) == order)
    return (bars.withColumn("piv_h", whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after)))
            .withColumn("piv_l", whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after))))


def with_trend(bars: DataFrame, rules: dict) -> DataFrame:
    """uptrend, strong_down and the words for them; needs sma50 and sma200."""
    c, s50, s200 = F.col("close"), F.col("sma50"), F.col("sma200")
    then = F.lag("sma200", rules["slope_lookback"] - 1).over(series())
    short = true(c < rules["strong_down_sma50"] * s50)
    up = F.when(s200.isNull(), true(c > s50)).otherwise(c > s200)
    down = F.when(s200.isNull() | F.col("s200_then").isNull(), short).otherwise((c < rules["strong_down"] * s200) & (s200 < F.col("s200_then")))
    slope = F.when(F.col("s200_then").isNull(), F.lit("SMA200 slope n/a")).when(s200 < F.col("s200_then"), F.lit("SMA200 falling")).otherwise(F.lit("SMA200 rising/flat"))
    side = F.when(F.col("uptrend"), F.lit("above")).otherwise(F.lit("below"))
    words = F.when(s200.isNull(), F.concat(F.lit("close "), side, F.lit(" SMA50 (SMA200 n/a)"))).otherwise(
        F.concat_ws(", ", F.concat(F.lit("close "), side, F.lit(" SMA200")), F.concat(F.lit("SMA50 "), F.when(s50 > s200, F.lit(">")).otherwise(F.lit("<")), F.lit(" SMA200")), slope))
    return bars.withColumn("s200_then", then).withColumn("uptrend", up).withColumn("strong_down", down).withColumn("trend", words)


def with_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """vr, the volume over its mean of the ``n`` bars before (2 decimals), and vz, its z-score."""
    frame = series().rowsBetween(-n, -1)
    mean, sd = F.avg("volume").over(frame), F.stddev_samp("volume").over(frame)
    return (bars.withColumn("vr", F.when((F.col("idx") >= 20) & (mean != 0), r(F.col("volume") / mean, 2)))
            .withColumn("vz", F.when((F.count("volume").over(frame) > 1) & (sd > 0), r((F.col("volume") - mean) / sd, 2))))


def enrich(bars: DataFrame, rules: dict) -> DataFrame:
    """Everything the detectors read, in one pass over each symbol's series."""
    out = with_volume(with_trend(with_pivots(with_smas(with_atr(bars, rules["atr_len"])), rules["pivot_order"]), rules), rules["volume_len"])
    back = lambda n: series().rowsBetween(-n, 0)
    out = out.withColumn("hi60", F.max("high").over(back(60))).withColumn("low_prior", F.min("low").over(back(rules["cup_prior_lookback"])))
    return out.withColumn("low_advance", F.min("low").over(back(rules["cup_advance_lookback"])))


def enrich_for(bars: DataFrame, variants: list[dict]) -> DataFrame:
    """:func:`enrich` by the first of several rules, with vr, low_prior and low_advance for every length among them, named by
    it. The other lengths of the panel have to be equal."""
    base = variants[0]
    for key in ("atr_len", "pivot_order", "strong_down", "strong_down_sma50", "slope_lookback"):
        if any(v[key] != base[key] for v in variants):
            raise ValueError(f"{key} has to be the same in all variants")
    out = enrich(bars, base)
    for n in sorted({v["volume_len"] for v in variants}):
        out = with_volume(out.drop("vz"), n).withColumn(f"vr_{n}", F.col("vr"))
    for name, key in (("low_prior", "cup_prior_lookback"), ("low_advance", "cup_advance_lookback")):
        for n in sorted({v[key] for v in variants}):
            out = out.withColumn(f"{name}_{n}", F.min("low").over(series().rowsBetween(-n, 0)))
    return out


def with_bollinger(bars: DataFrame) -> DataFrame:
    w = trailing(20)
    sd = full(F.stddev_pop("close"), "close", w, 20)
    return bars.withColumn("pctb", F.when(sd > 0, (F.col("close") - (F.avg("close").over(w) - 2 * sd)) / (4 * sd)))


#: Bars in a block of the smoothing recurrence: the inverse powers within it stay finite.
BLOCK = 256


def smooth(bars: DataFrame, name: str, value: Column, alpha: float, first: int = 0) -> DataFrame:
    """``name``: y = (1 - alpha) * y_before + alpha * value, from y = value at bar ``first``.

    Within a block of bars y is a prefix sum of scaled values. What earlier blocks add fades by keep**BLOCK each; three
    of them reach double precision for every alpha from 1/14 on, so series of any length stay finite.
    """
    keep, step = 1 - alpha, (1 - alpha) ** BLOCK
    t = F.col("idx") - first
    b = bars.withColumn("_t", t).withColumn("_b", F.floor(t / BLOCK)).withColumn("_i", F.pmod(t, F.lit(BLOCK)))
    gain = F.when(F.col("_t") == 0, value).when(F.col("_t") > 0, alpha * value) * F.pow(F.lit(keep), -F.col("_i"))
    inside = Window.partitionBy("symbol", "_b")
    b = b.withColumn("_p", F.sum(gain).over(inside.orderBy("idx")))
    b = b.withColumn("_e", F.max_by("_p", "idx").over(inside) * keep ** (BLOCK - 1))
    ends = Window.partitionBy("symbol").orderBy("_b")
    earlier = sum((F.coalesce(F.max("_e").over(ends.rangeBetween(-k, -k)), F.lit(0.0)) * step ** (k - 1) for k in (1, 2, 3)), F.lit(0.0))
    y = (F.col("_p") + earlier * keep) * F.pow(F.lit(keep), F.col("_i"))
    return b.withColumn(name, F.when(F.col("_t") >= 0, y)).drop("_t", "_b", "_i", "_p", "_e")


def with_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """rsi by Wilder's smoothing, seeded with the mean of the first ``n`` changes."""
    d = F.col("close") - F.lag("close").over(series())
    b = bars.withColumn("_g", F.greatest(d, F.lit(0.0))).withColumn("_l", F.greatest(-d, F.lit(0.0)))
    seed = lambda c: F.when(F.col("idx") == n, F.avg(c).over(trailing(n))).otherwise(F.col(c))
    b = b.withColumn("_g", seed("_g")).withColumn("_l", seed("_l"))
    b = smooth(smooth(b, "_ag", F.col("_g"), 1 / n, n), "_al", F.col("_l"), 1 / n, n)
    rsi = F.when((F.col("_ag") == 0) & (F.col("_al") == 0), 50.0).when(F.col("_al") == 0, 100.0).otherwise(r(100 - 100 / (1 + F.col("_ag") / F.col("_al")), 2))
    return b.withColumn("rsi", F.when(F.col("idx") >= n, rsi)).drop("_g", "_l", "_ag", "_al")


def with_macd(bars: DataFrame) -> DataFrame:
    """hist: the (12, 26, 9) histogram from bar 34 on (35 bars)."""
    b = smooth(smooth(bars, "_f", F.col("close"), 2 / 13), "_s", F.col("close"), 2 / 27).withColumn("_m", F.col("_f") - F.col("_s"))
    b = smooth(b, "_n", F.col("_m"), 2 / 10)
    return b.withColumn("hist_all", F.col("_m") - F.col("_n")).withColumn("hist", F.when(F.col("idx") >= 34, F.col("hist_all"))).drop("_f", "_s", "_m", "_n")


def with_midrank(bars: DataFrame, n: int = 250) -> DataFrame:
    """macd_pct: the mid-rank of the histogram among its last ``n`` values, in percent (1 decimal).

    Values are compared at 6 decimals, so that equal readings are equal in any summation order.
    """
    h = r(F.col("hist_all"), 6)
    window = F.collect_list(h).over(trailing(n))
    b = bars.withColumn("_w", window).withColumn("_h", h)
    below = F.size(F.filter("_w", lambda x: x < F.col("_h")))
    equal = F.size(F.filter("_w", lambda x: x == F.col("_h")))
    return b.withColumn("macd_pct", F.when(F.col("idx") >= 34, r((below + 0.5 * equal) / F.size("_w") * 100, 1))).drop("_w", "_h")


def with_fear_greed(bars: DataFrame) -> DataFrame:
    """fear_greed: the mean of RSI, MACD mid-rank and clipped %B over those the history allows (1 decimal)."""
    b = with_midrank(with_macd(with_rsi(with_bollinger(bars))))
    parts = F.array_compact(F.array("rsi", "macd_pct", F.least(F.greatest(r(F.col("pctb"), 3) * 100, F.lit(0.0)), F.lit(100.0))))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return b.withColumn("fear_greed", F.when(F.size(parts) > 0, r(total / F.size(parts), 1)))


def fear_greed_zone(score: Column) -> Column:
    return (F.when(score < 20, "extreme fear").when(score < 40, "fear").when(score < 60, "neutral").when(score < 80, "greed").when(score.isNotNull(), "extreme greed"))
