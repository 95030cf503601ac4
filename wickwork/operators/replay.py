"""Replay: what each past session's scan would have reported first, and what became of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.columns import r
from wickwork.functions.indicators import enrich_for
from wickwork.functions.rules import CUP, DOUBLE, IHS, LEGACY, PATTERNS, WOLFE, flat, profile
from wickwork.operators.detectors import interval, scan_variants, summaries
from wickwork.operators.market import only_members
from wickwork.operators.outcomes import described, month_bootstrap, scored, summary
from wickwork.sources.store import written

KEY = ("symbol", "pattern", "stop")


#: What :func:`features` adds.
FEATURES = ("close_vs_sma200", "sma50_vs_sma200", "sma200_slope", "dist_sma200_atr", "stop_atr", "target_atr", "wait_bars", "depth_atr", "break_close_pos", "break_over_prior_high", "volume_z",
            "handle_volume_ratio", "handle_volume_slope", "fg_score", "fg_rsi", "fg_macd_pct", "fg_bb_pctb", "fg_base")


def sessions(bars: DataFrame, days: int = 2**31 - 1, end: str | None = None) -> DataFrame:
    """(day, no): the last ``days`` distinct days (all by default) on or before ``end``, numbered from 0."""
    d = bars.select("day").distinct()
    if end:
        d = d.filter(F.col("day") <= F.lit(end).cast("date"))
    d = d.withColumn("back", F.row_number().over(Window.orderBy(F.desc("day")))).filter(F.col("back") <= days)
    return d.select("day", (F.row_number().over(Window.orderBy("day")) - 1).alias("no"))


def listed(signals: DataFrame, scan_days: DataFrame, snapshots: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Confirmed signals on the scan days (of members only, given snapshots) with the session number, first_day, listed_day;
    counted apart for each ``by``."""
    s = signals.filter("status = 'CONFIRMED'").join(F.broadcast(scan_days), "day")  # one row per session
    if snapshots is not None:
        s = only_members(s, "day", snapshots)
    w = Window.partitionBy(*KEY, *by)
    return s.withColumn("first_day", F.min("day").over(w)).withColumn("listed_day", (F.col("no") - F.min("no").over(w) + 1).cast("int"))


def first_seen(rows: DataFrame) -> DataFrame:
    return rows.filter("listed_day = 1 and day = first_day")


def repeats(rows: DataFrame) -> DataFrame:
    return rows.filter("day > first_day")


def pairs(first: DataFrame, later: DataFrame) -> DataFrame:
    """Traded later listings beside their traded first report: listed_day, r1, r, diff."""
    a = first.filter("r is not null").select(*KEY, "first_day", F.col("r").alias("r1"))
    return later.filter("r is not null").join(a, [*KEY, "first_day"]).withColumn("diff", F.col("r") - F.col("r1"))


def late_entry(rows: DataFrame) -> DataFrame:
    """Scored listings by day on the list, and the traded ones after day 1 against their own first report: the number of
    pairs, both means, the mean difference and its month-block interval."""
    by_day = rows.groupBy("listed_day").agg(*summary())
    p = pairs(first_seen(rows), repeats(rows))
    mean = lambda c, name: r(F.avg(c), 3).alias(name)
    compared = p.groupBy("listed_day").agg(F.count("*").alias("pairs"), mean("r1", "pair_day1_mean_r"), mean("r", "pair_mean_r"), mean("diff", "diff_mean_r"))
    spread = month_bootstrap(p.select("listed_day", F.col("first_day").alias("scan_day"), F.col("diff").alias("r"), "symbol", "d"), ("listed_day",), order=("scan_day", "symbol", "d"))
    spread = spread.select("listed_day", F.col("ci_low").alias("diff_ci_low"), F.col("ci_high").alias("diff_ci_high"))
    return by_day.join(compared, "listed_day", "left").join(spread, "listed_day", "left")


def windows(rows: DataFrame, day: str, split: str) -> DataFrame:
    """``rows`` once for all sessions and once for their side of ``split``, told apart by ``label``."""
    side = F.when(F.col(day) < F.lit(split).cast("date"), f"before {split}").otherwise(f"from {split}")
    return rows.withColumn("label", F.explode(F.array(F.lit("all sessions"), side)))


def under(bars: DataFrame, variants: dict[str, dict], horizon: int = 40) -> DataFrame:
    """First reports under each of the labelled rules, scored, with ``label``.

    Each pattern is scanned once for all labels: those whose rules are the same for it share a variant, and the variants are
    a table that the pattern's candidates meet. A signal is scored once and then counted for every label that has it.
    """
    e = written(enrich_for(bars, list(variants.values())))
    sums, found, uses = written(summaries(e)), [], []
    for pattern in PATTERNS:
        different: dict[str, int] = {}
        flats = {}
        for label, rules in variants.items():
            f = flat(rules, pattern)
            n = different.setdefault(repr(sorted(f.items())), len(different))
            flats[n] = f
            uses.append((label, pattern, n))
        found.append(written(scan_variants(e, flats, pattern, sums)))
    rows = first_seen(listed(reduce(DataFrame.unionByName, found), sessions(e), by=("variant",)))
    labels = bars.sparkSession.createDataFrame(uses, "label string, pattern string, variant int")
    return scored(rows, e, horizon).join(F.broadcast(labels), ["pattern", "variant"])  # a row for each label and pattern


def ablation(bars: DataFrame, base: str = "spec", relaxed: dict | None = None, horizon: int = 40) -> DataFrame:
    """What each rule of ``relaxed`` (the legacy profile's) does to the base profile when it alone takes that value: rule,
    value, delta (signals against the base), place (largest change first, the base last) and the statistics of its first reports."""
    relaxed = LEGACY if relaxed is None else relaxed
    whole = f"{base} (all rules)"
    rows = under(bars, {whole: profile(base)} | {k: profile(base, **{k: v}) for k, v in relaxed.items()}, horizon)
    stats = written(described(rows, ("label",)).withColumnRenamed("label", "rule"))
    keys = bars.sparkSession.createDataFrame([(whole, "-"), *((k, str(v)) for k, v in relaxed.items())], "rule string, value string")
    before = stats.filter(F.col("rule") == whole).agg(F.coalesce(F.max("signals"), F.lit(0).cast("long")).alias("_before"))
    out = keys.join(stats, "rule", "left").crossJoin(F.broadcast(before)).withColumn("signals", F.coalesce("signals", F.lit(0).cast("long")))
    out = out.withColumn("delta", F.col("signals") - F.col("_before")).drop("_before")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("rule") == whole, F.desc(F.abs("delta")), "rule")).cast("int"))


def _price(label: str):
    return F.filter("anchors", lambda a: a["label"] == label)[0]["price"]


def features(rows: DataFrame, e: DataFrame, mood: DataFrame) -> DataFrame:
    """First reports ``rows`` with ``FEATURES``, from enriched bars ``e`` and readings ``mood`` (symbol, idx, fear_greed, rsi,
    macd_pct, pctb): the trend and levels in ATR at the scan bar, the breakout bar, the depth, a cup's handle volume."""
    w = Window.partitionBy("symbol").orderBy("idx")
    at = e.withColumn("_then", F.lag("sma200", 40).over(w)).select("symbol", F.col("idx").alias("d"), F.col("close").alias("_c"), F.col("sma50").alias("_s50"), F.col("sma200").alias("_s200"), "_then", F.col("atr").alias("_atr"))
    brk = e.withColumn("_ph", F.lag("high").over(w)).select("symbol", F.col("idx").alias("_b"), F.col("close").alias("_bc"), F.col("high").alias("_bh"), F.col("low").alias("_bl"), "_ph", F.col("vz").alias("volume_z"))
    depth = (F.when(F.col("pattern") == CUP, _price("right rim") - _price("bottom")).when(F.col("pattern") == IHS, F.least(_price("LS"), _price("RS")) - _price("head"))
             .when(F.col("pattern") == WOLFE, _price("1") - _price("5")).when(F.col("pattern") == DOUBLE, _price("peak") - F.least(_price("L1"), _price("L2"))))
    s = rows.withColumn("_b", F.col("d") - F.col("bars_since_break")).withColumn("_depth", depth).join(at, ["symbol", "d"]).join(brk, ["symbol", "_b"])
    # A cup's handle ends before the breakout bar.
    rim = lambda label: F.filter("anchors", lambda a: a["label"] == label)[0]["idx"]
    cups = s.filter(F.col("pattern") == CUP).select("symbol", "d", "pattern", "stop", rim("left rim").alias("_a"), rim("right rim").alias("_r"), "_b")
    handle = F.when(F.col("j") > F.col("_r"), F.col("jvolume"))
    cups = interval(cups, e, F.col("_a"), F.col("_b") - 1, F.avg(F.when(F.col("j") <= F.col("_r"), F.col("jvolume"))).alias("_cup"), F.avg(handle).alias("_handle"), F.count(handle).alias("_n"), F.regr_slope(handle, F.col("j")).alias("_slope"))
    s = s.join(cups.drop("_a", "_r", "_b"), ["symbol", "d", "pattern", "stop"], "left")
    now = mood.select("symbol", F.col("idx").alias("d"), F.col("fear_greed").alias("fg_score"), r(F.col("rsi"), 1).alias("fg_rsi"), F.col("macd_pct").alias("fg_macd_pct"), r(F.col("pctb"), 3).alias("fg_bb_pctb"))
    then = mood.select("symbol", F.col("idx").alias("last"), F.col("fear_greed").alias("fg_base"))
    s = s.join(now, ["symbol", "d"], "left").join(then, ["symbol", "last"], "left")
    c, s50, s200, atr = (F.col(x) for x in ("_c", "_s50", "_s200", "_atr"))
    span = F.col("_bh") - F.col("_bl")
    new = {"close_vs_sma200": r(c / s200 - 1, 4), "sma50_vs_sma200": r(s50 / s200 - 1, 4), "sma200_slope": r(s200 / F.col("_then") - 1, 4), "dist_sma200_atr": r((c - s200) / atr, 3),
           "stop_atr": r((F.col("entry") - F.col("stop")) / atr, 3), "target_atr": r((F.col("target") - F.col("entry")) / atr, 3), "wait_bars": (F.col("_b") - F.col("last")).cast("int"), "depth_atr": r(F.col("_depth") / atr, 3),
           "break_close_pos": F.when(span > 0, r((F.col("_bc") - F.col("_bl")) / span, 3)), "break_over_prior_high": F.when(F.col("_bc") > F.col("_ph"), 1.0).otherwise(0.0),
           "handle_volume_ratio": F.when(F.col("_cup") > 0, r(F.col("_handle") / F.col("_cup"), 3)), "handle_volume_slope": F.when((F.col("_n") >= 3) & (F.col("_handle") > 0), r(F.col("_slope") / F.col("_handle"), 4))}
    s = s.withColumns(new)
    return s.drop(*[x for x in s.columns if x.startswith("_")])
