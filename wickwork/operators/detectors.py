"""The four chart patterns as candidate tables, and their state as of any bar.

A candidate's geometry never changes once its last pivot is known, so it is computed once for a whole series. Whether it is
confirmed or watched on bar d follows from the first close above its trigger line and the bar d itself: a join of candidates
to bars by symbol and block, and only to blocks whose highest and lowest close do not rule it out. The nightly scan is the same
job for the last bar alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.columns import r, series, true
from wickwork.functions.indicators import with_restarted_atr
from wickwork.functions.rules import CUP, DOUBLE, IHS, PATTERNS, WOLFE, Fixed, Joined, rules_table
from wickwork.sources.store import written

#: Symbols need this many bars up to the bar that is looked at.
HISTORY = 60
#: A candidate is numbered by its first and last anchor: first * SPAN + last.
SPAN = 1 << 31
#: What every candidate table has; ``anchors`` lists what the geometry rests on.
COMMON = ("symbol", "pattern", "cand", "known", "until", "start", "v0", "i0", "slope", "floor", "last", "last_low", "last_atr",
          "height", "size", "target_at", "score0", "decline_ok", "anchors")


#: What candidates and signals also have when many rules are applied at once.
VARIANT = ("variant", "rule")


#: Bars of a block: a candidate meets the blocks that its range touches, not the whole series.
BLOCK = 64


def interval(c: DataFrame, bars: DataFrame, low: Column, high: Column, *aggregates: Column) -> DataFrame:
    """Aggregates over the bars (as j, jhigh, jlow, jclose, jvolume) of a candidate from ``low`` to ``high``."""
    b = bars.select(F.col("symbol").alias("jsymbol"), F.col("idx").alias("j"), F.floor(F.col("idx") / BLOCK).alias("jblock"), *[F.col(x).alias(f"j{x}") for x in ("high", "low", "close", "volume")])
    ranged = c.withColumn("_low", low).withColumn("_high", high).filter(F.col("_low") <= F.col("_high"))
    ranged = ranged.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_low") / BLOCK), F.floor(F.col("_high") / BLOCK))))
    same = (F.col("symbol") == F.col("jsymbol")) & (F.col("_block") == F.col("jblock"))
    return ranged.join(b, same & F.col("j").between(F.col("_low"), F.col("_high"))).groupBy(*c.columns).agg(*aggregates)


def anchor(label: str, idx: str, price: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.col(idx).cast("int").alias("idx"), F.col(price).alias("price"))


def _off(rule: Column, condition: Column) -> Column:
    """A condition that a null rule turns off."""
    return rule.isNull() | condition


def _within(value: Column, q, key: str) -> Column:
    return (value >= q(f"{key}_lo")) & (value <= q(f"{key}_hi"))


def _lows(e: DataFrame, n: int, q, key: str) -> DataFrame:
    """Each swing low with the next ``n - 1`` ones: i1, low1, atr1, ... and hi60 at the first; no wider or narrower than any
    of the rules allows."""
    shallowest = F.least("atr", F.array_min("atr_parts")) if q.windowed else F.col("atr")
    lows = e.filter("piv_l").select("symbol", F.col("idx").alias("i1"), F.col("low").alias("low1"), F.col("atr").alias("atr1"), F.col("close").alias("close1"), shallowest.alias("unit1"), "hi60")
    w = Window.partitionBy("symbol").orderBy("i1")
    for k in range(2, n + 1):
        for c in ("i", "low", "atr", "close", "unit"):
            lows = lows.withColumn(f"{c}{k}", F.lead(f"{c}1", k - 1).over(w))
    return lows.filter((F.col(f"i{n}") - F.col("i1")).between(q.loosest(f"{key}_lo", True), q.loosest(f"{key}_hi", False)))


def _first_max(name: str, side: Column | None = None) -> Column:
    """(value, index) of the highest high, first of equals, of all bars or of a ``side``."""
    high = F.struct(F.col("jhigh").alias("v"), (-F.col("j")).alias("i"))
    return F.max(high if side is None else F.when(side, high)).alias(name)


def _ruled(c: DataFrame, table: DataFrame | None) -> DataFrame:
    """``c`` once for each variant of a rules table (few rows, so it is broadcast), or as it is without one."""
    return c if table is None else c.crossJoin(F.broadcast(table))


def double_bottom(e: DataFrame, q, table: DataFrame | None = None) -> DataFrame:
    c = _lows(e, 2, q, "db_len").withColumn("lower", F.least("low1", "low2")).withColumn("higher", F.greatest("low1", "low2")).filter("atr2 > 0")
    c = c.filter(F.abs(F.col("low1") - F.col("low2")) <= q.loosest("db_low_tol", False) * F.col("lower"))
    c = interval(c, e, F.col("i1") + 1, F.col("i2") - 1, _first_max("top")).withColumn("peak", F.col("top.v")).withColumn("p", -F.col("top.i"))
    c = _ruled(c.withColumn("ratio", (F.col("p") - F.col("i1")) / F.greatest(F.col("i2") - F.col("p"), F.lit(1))), table)
    c = c.filter(_within(F.col("i2") - F.col("i1"), q, "db_len") & (F.abs(F.col("low1") - F.col("low2")) <= q("db_low_tol") * F.col("lower")))
    c = c.filter((F.col("peak") - F.col("higher") >= q("db_min_depth_atr") * F.col("atr2")) & (F.col("peak") >= F.col("higher") * (1 + q("db_min_rise"))))
    c = c.filter((F.col("ratio") <= q("db_time_sym")) & (F.col("ratio") >= 1 / q("db_time_sym")))
    height = F.col("peak") - F.col("lower")
    score = (50 + 15 * (1 - F.least(F.abs(F.col("low1") - F.col("low2")) / (q("db_low_tol") * F.col("lower")), F.lit(1.0)))
             + 10 * (1 - F.abs(F.ln("ratio")) / F.ln(q("db_time_sym")))
             + 10 * F.greatest(F.lit(0.0), F.least((F.col("peak") / F.col("higher") - 1) / q("db_min_rise") - 1, F.lit(1.0))))
    return _common(c, DOUBLE, cand=F.col("i1") * SPAN + F.col("i2"), known=F.col("i2") + 5, start=F.col("i2") + 1, v0=F.col("peak"), floor=F.col("low2"), last=F.col("i2"), last_low=F.col("low2"),
                   last_atr=F.col("atr2"), height=height, size=height, score0=score, decline_ok=true(F.col("hi60") - F.col("low1") >= q("db_prior_decline_of_height") * height),
                   anchors=F.array(anchor("L1", "i1", "low1"), anchor("peak", "p", "peak"), anchor("L2", "i2", "low2")))


def inverse_hs(e: DataFrame, q, table: DataFrame | None = None) -> DataFrame:
    c = _lows(e, 3, q, "ihs_len")
    # Seen through a window, the head's range may be less than in the whole series; such candidates are judged with it.
    deep = lambda rule: (F.col("low2") < F.col("low1") - rule * F.col("unit2")) & (F.col("low2") < F.col("low3") - rule * F.col("unit2"))
    c = c.filter(deep(q.loosest("ihs_min_head_atr", True))).withColumn("ratio", (F.col("i2") - F.col("i1")) / F.greatest(F.col("i3") - F.col("i2"), F.lit(1)))
    c = c.withColumn("shallow", F.least(F.col("low1"), F.col("low3")) - F.col("low2")).withColumn("skew", F.abs(F.col("low1") - F.col("low3")))
    c = interval(c, e, F.col("i1") + 1, F.col("i3") - 1, _first_max("t1", F.col("j") < F.col("i2")), _first_max("t2", F.col("j") > F.col("i2")))
    c = c.withColumn("n1", -F.col("t1.i")).withColumn("n2", -F.col("t2.i")).withColumn("h1", F.col("t1.v")).withColumn("h2", F.col("t2.v")).drop("t1", "t2")
    c = c.withColumn("slope", (F.col("h2") - F.col("h1")) / (F.col("n2") - F.col("n1"))).withColumn("tilt", F.abs(F.col("slope") * (F.col("i3") - F.col("i1"))) / F.col("close2"))
    c = c.withColumn("head", F.col("h1") + F.col("slope") * (F.col("i2") - F.col("n1")) - F.col("low2"))
    left, right = F.col("n1") - F.col("i1"), F.col("i3") - F.col("n2")
    c = _ruled(c.withColumn("side", F.abs(left - right) / F.greatest(left, right)), table)
    c = c.filter(_within(F.col("i3") - F.col("i1"), q, "ihs_len") & deep(q("ihs_min_head_atr")) & _off(q("ihs_shoulder_sym"), F.col("skew") <= q("ihs_shoulder_sym") * F.col("shallow")))
    c = c.filter((F.col("ratio") <= q("ihs_time_sym")) & (F.col("ratio") >= 1 / q("ihs_time_sym")) & (F.col("tilt") <= q("ihs_max_neck_slope")))
    c = c.filter(_off(q("ihs_shoulder_sym_of_height"), F.col("skew") <= q("ihs_shoulder_sym_of_height") * F.col("head")) & _off(q("ihs_side_sym_tol"), F.col("side") <= q("ihs_side_sym_tol")))
    decline = F.col("hi60") - F.col("low1")
    ok = true(decline / F.col("hi60") >= q("ihs_prior_decline")) | true(decline >= q("ihs_prior_decline_of_height") * F.col("head"))
    limit = F.coalesce(q("ihs_shoulder_sym") * F.col("shallow"), F.coalesce(q("ihs_shoulder_sym_of_height"), F.lit(0.0)) * F.col("head"))
    score = (50 + 15 * (1 - F.least(F.col("skew") / F.greatest(limit, F.lit(1e-9)), F.lit(1.0))) + 10 * (1 - F.abs(F.ln("ratio")) / F.ln(q("ihs_time_sym")))
             + 10 * (1 - F.least(F.col("tilt") / q("ihs_max_neck_slope"), F.lit(1.0))))
    # Without a height the target is measured from the trigger down to the head.
    return _common(c, IHS, cand=F.col("i1") * SPAN + F.col("i3"), known=F.col("i3") + 5, start=F.col("i3") + 1, v0=F.col("h1"), i0=F.col("n1"), slope=F.col("slope"), floor=F.col("low3"),
                   last=F.col("i3"), last_low=F.col("low3"), last_atr=F.col("atr3"), height=F.when(q("ihs_target_at_head"), F.col("head")), size=F.col("head"), target_at=F.col("low2"),
                   score0=score, decline_ok=ok, anchors=F.array(anchor("LS", "i1", "low1"), anchor("head", "i2", "low2"), anchor("RS", "i3", "low3")))


def wolfe(e: DataFrame, q, table: DataFrame | None = None) -> DataFrame:
    c = _lows(e, 3, q, "ww_len").filter("low2 < low1 and low3 < low2")
    c = interval(c, e.filter("piv_h"), F.col("i1") + 1, F.col("i3") - 1, _first_max("t2", F.col("j") < F.col("i2")), _first_max("t4", F.col("j") > F.col("i2")))
    c = c.filter("t2 is not null and t4 is not null").withColumn("p2", -F.col("t2.i")).withColumn("p4", -F.col("t4.i")).withColumn("v2", F.col("t2.v")).withColumn("v4", F.col("t4.v")).drop("t2", "t4")
    c = c.filter("v4 < v2 and low1 < v4").withColumn("s13", (F.col("low2") - F.col("low1")) / (F.col("i2") - F.col("i1"))).withColumn("s24", (F.col("v4") - F.col("v2")) / (F.col("p4") - F.col("p2")))
    c = _ruled(c.filter("s24 < s13").withColumn("over", F.col("low1") + F.col("s13") * (F.col("i3") - F.col("i1")) - F.col("low3")), table)
    sweet = (F.col("over") >= 0) & (F.col("low3") >= F.col("low2") + F.col("s24") * (F.col("i3") - F.col("i2")))
    loose = (F.col("over") >= -0.5 * F.col("atr3")) & (F.col("over") <= q("ww_max_overshoot_atr") * F.col("atr3"))
    c = c.filter(_within(F.col("i3") - F.col("i1"), q, "ww_len") & F.when(q("ww_sweet_zone"), sweet).otherwise(loose))
    legs = [F.col("p2") - F.col("i1"), F.col("i2") - F.col("p2"), F.col("p4") - F.col("i2")]
    mean = (legs[0] + legs[1] + legs[2]) / 3
    c = c.filter(_off(q("ww_time_sym_tol"), reduce(lambda a, b: a & b, [F.abs(x - mean) <= q("ww_time_sym_tol") * mean for x in legs])))
    eta = (F.col("v2") - F.col("s24") * F.col("p2") - (F.col("low1") - F.col("s13") * F.col("i1"))) / (F.col("s13") - F.col("s24"))
    c = c.withColumn("eta", eta)
    epa = F.col("low1") + (F.col("v4") - F.col("low1")) / (F.col("p4") - F.col("i1")) * (F.col("eta") - F.col("i1"))
    epa = F.when((F.col("eta") > F.col("i3")) & (F.col("eta") <= F.col("i3") + q("ww_max_eta_bars")), epa)
    sym = (F.col("i2") - F.col("i1")) / F.greatest(F.col("i3") - F.col("i2"), F.lit(1))
    score = (50 + 15 * (1 - F.least(F.abs("over") / (q("ww_max_overshoot_atr") * F.col("atr3")), F.lit(1.0))) + 10 * (1 - F.least(F.abs(F.ln(sym)) / F.ln(F.lit(3.0)), F.lit(1.0))))
    return _common(c, WOLFE, cand=F.col("i1") * SPAN + F.col("i3"), known=F.col("i3") + 5, until=F.col("i3") + q("ww_max_bars_since_p5"), start=F.col("i3") + 1, v0=F.col("low1"), i0=F.col("i1"),
                   slope=F.col("s13"), floor=F.col("low3"), last=F.col("i3"), last_low=F.col("low3"), last_atr=F.col("atr3"), target_at=epa, score0=score, decline_ok=F.lit(True),
                   anchors=F.array(anchor("1", "i1", "low1"), anchor("2", "p2", "v2"), anchor("3", "i2", "low2"), anchor("4", "p4", "v4"), anchor("5", "i3", "low3")))


def cup_pairs(e: DataFrame, q, table: DataFrame | None = None) -> DataFrame:
    """Rim pairs that pass depth, rim, zone and retrace rules: a, b, rims, bottom, and the handle rules (least, most, share)."""
    tops = e.filter("piv_h")
    back = [c for c in e.columns if c.startswith(("low_prior", "low_advance"))]
    a = tops.select("symbol", F.col("idx").alias("a"), F.col("high").alias("rim_a"), *back)
    b = tops.select(F.col("symbol").alias("bsymbol"), F.col("idx").alias("b"), F.col("high").alias("rim_b"))
    c = a.join(b, (F.col("symbol") == F.col("bsymbol")) & (F.col("b") - F.col("a")).between(q.loosest("cup_len_lo", True), q.loosest("cup_len_hi", False))).drop("bsymbol")
    c = interval(c, e, F.col("a"), F.col("b"), F.min(F.struct(F.col("jlow").alias("v"), F.col("j").alias("i"))).alias("m")).withColumn("bottom", F.col("m.v")).withColumn("bi", F.col("m.i")).drop("m")
    c = _ruled(c.withColumn("depth", (F.col("rim_a") - F.col("bottom")) / F.col("rim_a")), table)
    c = c.filter(_within(F.col("b") - F.col("a"), q, "cup_len") & _within(F.col("depth"), q, "cup_depth") & _within((F.col("bi") - F.col("a")) / (F.col("b") - F.col("a")), q, "cup_bottom_zone"))
    apart, fall = F.abs(F.col("rim_b") - F.col("rim_a")), F.col("rim_a") - F.col("bottom")
    c = c.filter(F.when(q("cup_rim_tol_of_depth").isNull(), apart <= q("cup_rim_tol") * F.col("rim_a")).otherwise(apart <= q("cup_rim_tol_of_depth") * fall))
    c = c.filter(_off(q("cup_max_retrace"), fall <= q("cup_max_retrace") * (F.col("rim_a") - q.panel("low_advance", "cup_advance_lookback"))))
    return c.withColumn("least", q("handle_len_lo")).withColumn("most", q("handle_len_hi")).withColumn("share", q("handle_max_len_of_cup"))


def u_shape(c: DataFrame, e: DataFrame) -> DataFrame:
    """``u``: R2 of the parabola through the lows of [a, b]; 0 if it opens downward, or for under 5 or equal lows.

    On equally spaced bars the linear and the quadratic part are orthogonal, so their R2 add up.
    """
    m = F.col("b") - F.col("a") + 1
    t = F.col("j") - F.col("a") - (m - 1) / 2
    q = t * t - (m * m - 1) / 12
    y = F.col("jlow")
    fit = F.when((F.count("j") >= 5) & (F.var_pop(y) > 0) & (F.regr_slope(y, q) > 0), F.regr_r2(y, t) + F.regr_r2(y, q)).otherwise(0.0)
    return interval(c.select("symbol", "a", "b", "bi").distinct(), e, F.col("a"), F.col("b"), F.greatest(fit, F.lit(0.0)).alias("u"))


def v_shape(c: DataFrame, e: DataFrame) -> DataFrame:
    """``v``: the best R2 of a V through the lows of [a, b] with its vertex near the bottom."""
    m, rel = F.col("b") - F.col("a") + 1, F.col("bi") - F.col("a")
    half = F.greatest(F.lit(3), F.floor(m / 10).cast("int"))
    vertices = F.sequence(F.greatest(F.lit(1), rel - half), F.least(m - 2, rel + half))
    y, d = F.col("jlow"), F.abs(F.col("j") - F.col("a") - F.col("vertex"))
    one = F.when((F.count("j") >= 5) & (F.var_pop(y) > 0) & (F.regr_slope(y, d) > 0), F.regr_r2(y, d)).otherwise(0.0)
    return interval(c.withColumn("vertex", F.explode(vertices)), e, F.col("a"), F.col("b"), one.alias("one")).groupBy(*c.columns).agg(F.max("one").alias("v"))


def handles(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """The handles of rim pairs (symbol, a, b, least, most, share): end, the bars known to until on which it is the handle,
    hh, hl, hl_i, hl_atr.

    A close above the running high, from the bar after the least length on, ends the handle for good; until then each bar
    has the handle so far.
    """
    pairs = pairs.select("symbol", "a", "b", "least", "most", "share").distinct()
    rim = ("symbol", "b", "least", "most")
    b = e.select(F.col("symbol").alias("jsymbol"), F.col("idx").alias("end"), F.floor(F.col("idx") / BLOCK).alias("jblock"), "high", "low", "close", "atr")
    w = Window.partitionBy(*rim).orderBy("end")
    rims = pairs.select(*rim).distinct().withColumn("_block", F.explode(F.sequence(F.floor((F.col("b") + 1) / BLOCK), F.floor((F.col("b") + F.col("most")) / BLOCK))))
    h = rims.join(b, (F.col("symbol") == F.col("jsymbol")) & (F.col("_block") == F.col("jblock")) & (F.col("end") > F.col("b")) & (F.col("end") <= F.col("b") + F.col("most"))).drop("jsymbol", "_block", "jblock")
    h = (h.withColumn("hh", F.max("high").over(w)).withColumn("before", F.lag("hh").over(w))
         .withColumn("m", F.min(F.struct(F.col("low").alias("v"), F.col("end").alias("i"), F.col("atr").alias("t"))).over(w)))
    crossed = (F.col("end") >= F.col("b") + F.col("least") + 1) & (F.col("close") > F.col("before"))
    h = h.withColumn("j", F.min(F.when(crossed, F.col("end"))).over(Window.partitionBy(*rim)))
    longest = F.least(F.col("most"), F.coalesce(F.floor((F.col("b") - F.col("a")) * F.col("share")).cast("int"), F.col("most")))
    h = pairs.join(h, list(rim)).withColumn("max_end", F.col("b") + longest)
    h = h.withColumn("j", F.when(F.col("j") <= F.col("max_end"), F.col("j"))).filter((F.col("end") >= F.col("b") + F.col("least")) & (F.col("end") <= F.least(F.col("max_end"), F.coalesce(F.col("j") - 1, F.col("max_end")))))
    final = F.col("end") == F.coalesce(F.col("j") - 1, F.col("max_end"))
    # The last handle counts from its own last bar (j exists: the bar before it) to the end of data.
    return h.select("symbol", "a", "b", "least", "most", "share", "end", F.col("end").alias("known"), F.when(final, F.lit(2**30)).otherwise(F.col("end")).alias("until"), "hh", F.col("m.v").alias("hl"), F.col("m.i").alias("hl_i"), F.col("m.t").alias("hl_atr"))


def rounded(pairs: DataFrame, e: DataFrame, q) -> DataFrame:
    """``pairs`` that are round enough, with u and v; each different pair is fitted once."""
    shape = pairs.select("symbol", "a", "b", "bi").distinct()
    shape = u_shape(shape, e).filter(F.col("u") >= q.loosest("cup_min_roundness", True))
    c = pairs.join(v_shape(shape, e), ["symbol", "a", "b", "bi"])
    return c.filter((F.col("u") >= q("cup_min_roundness")) & (F.col("v") - F.col("u") <= q("cup_max_v_advantage")))


def cup_handle(e: DataFrame, q, table: DataFrame | None = None) -> DataFrame:
    c = rounded(cup_pairs(e, q, table), e, q)
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"h.{x}")) for x in ("share",)] + [F.col(f"c.{x}") == F.col(f"h.{x}") for x in ("symbol", "a", "b", "least", "most")]
    c = c.alias("c").join(handles(e, c).alias("h"), reduce(lambda x, y: x & y, same)).select("c.*", *[f"h.{x}" for x in ("end", "known", "until", "hh", "hl", "hl_i", "hl_atr")])
    c = c.withColumn("hdepth", (F.col("rim_b") - F.col("hl")) / F.col("rim_b"))
    c = c.filter((F.col("hdepth") <= q("handle_max_depth")) & (F.col("hl") >= F.col("bottom") + 0.5 * (F.col("rim_b") - F.col("bottom"))) & (F.col("hdepth") <= q("handle_fraction_of_cup") * F.col("depth")))
    level = F.when(q("cup_trigger") == "rim_b", F.greatest("hh", "rim_b")).otherwise(F.col("hh"))
    base = F.when(q("cup_target_base") == "right_rim", F.col("rim_b")).when(q("cup_target_base") == "left_rim", F.col("rim_a"))
    least, low = q("cup_min_roundness"), q.panel("low_prior", "cup_prior_lookback")
    score = (50 + 15 * (F.col("u") - least) / (1 - least) + 10 * (1 - F.least(F.abs(F.col("depth") - 0.25) / 0.25, F.lit(1.0)))
             + 10 * (1 - F.least(F.col("hdepth") / q("handle_max_depth"), F.lit(1.0))))
    return _common(c, CUP, cand=F.col("a") * SPAN + F.col("b"), known=F.col("known"), until=F.col("until"), start=F.col("end") + 1, v0=level, last=F.col("hl_i"), last_low=F.col("hl"), last_atr=F.col("hl_atr"),
                   height=base - F.col("bottom"), target_at=F.col("bottom"), score0=score, decline_ok=(F.col("rim_a") - low) / low >= q("cup_prior_advance"),
                   anchors=F.array(anchor("left rim", "a", "rim_a"), anchor("bottom", "bi", "bottom"), anchor("right rim", "b", "rim_b"), anchor("handle low", "hl_i", "hl")))


def _common(c: DataFrame, pattern: str, *, until=None, i0=None, slope=None, floor=None, height=None, size=None, target_at=None, **columns) -> DataFrame:
    number = lambda x: F.lit(None).cast("double") if x is None else x.cast("double")
    columns |= {"until": F.lit(2**30) if until is None else until, "i0": F.lit(0) if i0 is None else i0, "slope": F.lit(0.0) if slope is None else slope,
                "floor": number(floor), "height": number(height), "size": number(size), "target_at": number(target_at), "pattern": F.lit(pattern)}
    return c.select("symbol", *[columns[x].alias(x) for x in COMMON[1:]], *[x for x in VARIANT if x in c.columns])


DETECTORS = {CUP: cup_handle, IHS: inverse_hs, DOUBLE: double_bottom, WOLFE: wolfe}


#: What a candidate's trigger line rests on.
LINE = ("symbol", "start", "v0", "slope", "i0")


def line(at: Column) -> Column:
    """The trigger of a candidate at bar ``at``."""
    return F.col("v0") + F.col("slope") * (at - F.col("i0"))


def summaries(e: DataFrame) -> DataFrame:
    """(symbol, blocks): a symbol's blocks of bars in order, each with its first and last bar, its highest close and a bar
    that has it, and its lowest close."""
    b = e.groupBy("symbol", F.floor(F.col("idx") / BLOCK).alias("b")).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.max("close").alias("top"), F.max_by("idx", "close").alias("at"), F.min("close").alias("low"))
    return b.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("b", "lo", "hi", "top", "at", "low"))).alias("blocks"))


def read_blocks(rows: DataFrame, e: DataFrame, blocks: Column, *columns: str) -> DataFrame:
    """``rows`` joined to the bars of ``blocks`` (an array of block numbers), as j and j + each of ``columns``."""
    b = e.select(F.col("symbol").alias("jsymbol"), F.floor(F.col("idx") / BLOCK).alias("jblock"), F.col("idx").alias("j"), *[F.col(c).alias(f"j{c}") for c in columns])
    rows = rows.withColumn("_b", F.explode(blocks))
    return rows.join(b, (F.col("symbol") == F.col("jsymbol")) & (F.col("_b") == F.col("jblock"))).drop("jsymbol", "jblock", "_b")


def passage_blocks() -> Column:
    """The blocks that can hold the first close above a line, from ``blocks``: the block of the start; and of the later ones,
    up to the first whose highest close is surely above the line, those whose highest close is above its lowest point."""
    later = F.filter("blocks", lambda x: (x["b"] > F.floor(F.col("start") / BLOCK)) & (x["top"] > F.least(line(x["lo"]), line(x["hi"]))))
    sure = F.get(F.filter(later, lambda x: x["top"] > line(x["at"])), F.lit(0))["b"]
    kept = F.filter(later, lambda x: x["b"] <= F.coalesce(sure, x["b"]))
    return F.concat(F.array(F.floor(F.col("start") / BLOCK)), F.transform(kept, lambda x: x["b"]))


def candidates(e: DataFrame, rules: dict, pattern: str, windowed: bool = False) -> DataFrame:
    """The candidates of one pattern under one profile."""
    return DETECTORS[pattern](e, Fixed(rules, pattern, windowed))


def breakouts(c: DataFrame, e: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """``c`` with ``fb``, the first bar from ``start`` on whose close is above the trigger line (null without one).

    Blocks of bars are ruled out by their highest close, so a line meets the bars of few blocks (:func:`passage_blocks`).
    """
    lines = c.select(*LINE).distinct().join(summaries(e) if sums is None else sums, "symbol").withColumn("_read", passage_blocks()).drop("blocks")
    hit = read_blocks(lines, e, F.col("_read"), "close").filter((F.col("j") >= F.col("start")) & (F.col("jclose") > line(F.col("j"))))
    return c.join(hit.groupBy(*LINE).agg(F.min("j").alias("fb")), list(LINE), "left")


def report_blocks(q) -> Column:
    """The blocks that can hold bars on which a candidate is reported: those right after its breakout, and those with a close
    near enough below the line (and above the floor)."""
    near = 1 - q("watch_proximity")
    young = lambda x: (x["lo"] <= F.col("fb") + q("max_age")) & (x["hi"] >= F.col("fb"))
    watched = lambda x: (x["top"] >= F.least(line(x["lo"]), line(x["hi"])) * near) & (x["low"] <= F.greatest(line(x["lo"]), line(x["hi"]))) & (F.col("floor").isNull() | (x["top"] > F.col("floor")))
    on = F.filter("blocks", lambda x: (x["hi"] >= F.greatest(F.col("known"), F.lit(HISTORY - 1))) & (x["lo"] <= F.col("until")) & (true(young(x)) | watched(x)))
    return F.transform(on, lambda x: x["b"])


def extremes(e: DataFrame, longest: int) -> DataFrame:
    """(symbol, level, at, hi, lo): the highest high and lowest low of the 2^level bars from bar ``at`` on, up to ``longest``
    bars: two rows that overlap cover any stretch of bars, so a stretch is looked up by equality."""
    b, w = e.select("symbol", "idx", F.col("high").alias("hi0"), F.col("low").alias("lo0")), series()
    top = longest.bit_length() - 1
    for k in range(top):
        ahead = lambda c: F.lead(c, 2**k).over(w)  # noqa: B023, E731
        b = b.withColumn(f"hi{k + 1}", F.greatest(f"hi{k}", ahead(f"hi{k}"))).withColumn(f"lo{k + 1}", F.least(f"lo{k}", ahead(f"lo{k}")))
    rows = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"hi{k}").alias("hi"), F.col(f"lo{k}").alias("lo")) for k in range(top + 1)])
    return b.select("symbol", F.col("idx").alias("at"), F.explode(rows).alias("x")).select("symbol", "at", "x.*")


def looked_up(rows: DataFrame, table: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """``rows`` with name_hi and name_lo, the extremes of the bars from ``low`` to ``high``."""
    level = F.length(F.bin(high - low + 1)) - 1
    out = rows.withColumn("level", level).withColumn("_one", low.cast("long")).withColumn("_two", (high - F.call_function("shiftleft", F.lit(1), F.col("level")) + 1).cast("long"))
    for k in ("_one", "_two"):
        out = out.join(table.select("symbol", "level", F.col("at").cast("long").alias(k), F.col("hi").alias(f"hi{k}"), F.col("lo").alias(f"lo{k}")), ["symbol", "level", k])
    return out.withColumn(f"{name}_hi", F.greatest("hi_one", "hi_two")).withColumn(f"{name}_lo", F.least("lo_one", "lo_two")).drop("level", "_one", "_two", "hi_one", "lo_one", "hi_two", "lo_two")


def in_window(s: DataFrame, e: DataFrame, q, pattern: str, bars: int, table: DataFrame) -> DataFrame:
    """States as a scan of the last ``bars`` bars sees them: all anchors are pivots inside it, looks back from the first of
    them end at its first bar, and so does the range that a head's depth is measured in. ``table`` has the :func:`extremes`.

    The averages need 240 bars and the volume 20, so a shorter window or a longer volume raises.
    """
    if bars < 240 or q.flat["volume_len"] > 20:
        raise ValueError("a window has at least 240 bars, and volume_len of at most 20")
    price = lambda i: F.col("anchors")[i]["price"]
    s = s.withColumn("_start", F.col("d") - (bars - 1)).withColumn("_first", F.floor(F.col("cand") / SPAN)).filter(F.col("_first") >= F.col("_start") + 5)
    back = lambda n: F.greatest(F.col("_first") - n, F.col("_start"), F.lit(0))
    if pattern in (DOUBLE, IHS):
        s = looked_up(s, table, back(60), F.col("_first"), "w")
        fall = F.col("w_hi") - price(0)
    if pattern == DOUBLE:
        s = s.withColumn("decline_ok", true(fall >= q("db_prior_decline_of_height") * F.col("size")))
    if pattern == IHS:
        s = s.withColumn("decline_ok", true(fall / F.col("w_hi") >= q("ihs_prior_decline")) | true(fall >= q("ihs_prior_decline_of_height") * F.col("size")))
        at = e.select("symbol", F.col("idx").alias("_head"), F.col("atr").alias("_atr"), F.col("atr_parts").alias("_parts"))
        s = s.withColumn("_head", F.col("anchors")[1]["idx"]).join(at, ["symbol", "_head"])
        since = F.col("_head") - F.greatest(F.col("_start"), F.lit(0))
        deep = q("ihs_min_head_atr") * F.when(since >= F.size("_parts"), F.col("_atr")).otherwise(F.get("_parts", since.cast("int")))
        s = s.filter((price(1) < price(0) - deep) & (price(1) < price(2) - deep))
    if pattern == CUP:
        s = looked_up(s, table, back(q("cup_prior_lookback")), F.col("_first"), "w")
        s = looked_up(s, table, back(q("cup_advance_lookback")), F.col("_first"), "v")
        s = s.withColumn("decline_ok", (price(0) - F.col("w_lo")) / F.col("w_lo") >= q("cup_prior_advance"))
        s = s.filter(_off(q("cup_max_retrace"), price(0) - price(1) <= q("cup_max_retrace") * (price(0) - F.col("v_lo"))))
    return s


def states(c: DataFrame, e: DataFrame, q, pattern: str, days: DataFrame | None = None, bars: int | None = None, sums: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """Signals of one pattern as of bars d (all bars, or those of ``days`` (symbol, d)), before the best are picked.

    With ``bars`` each scan sees that many bars; ``table`` has their :func:`extremes`."""
    sums = written(summaries(e)) if sums is None else sums
    volume = [x for x in e.columns if x == "vr" or x.startswith("vr_")]
    c = breakouts(c, e, sums).join(e.select("symbol", F.col("idx").alias("fb"), *volume), ["symbol", "fb"], "left")
    c = c.withColumn("fb_vr", q.panel("vr", "volume_len")).drop(*volume)
    # After its wait, if there is a limit, a candidate is reported only while its breakout is young.
    c = c.withColumn("until", F.least("until", F.greatest(F.col("last") + q("max_wait_bars"), F.when(q("max_wait_bars").isNotNull(), F.coalesce(F.col("fb") + q("max_age"), F.lit(0))))))
    day = ("day", "close", "sma50", "sma200", "uptrend", "strong_down", "trend")
    if days is not None:  # a candidate meets the bars that are asked for
        s = c.join(e.select("symbol", F.col("idx").alias("d"), *day).join(days, ["symbol", "d"]), "symbol")
    else:
        s = c.join(sums, "symbol").withColumn("_read", report_blocks(q)).drop("blocks")
        s = read_blocks(s, e, F.col("_read"), *day).drop("_read").withColumnsRenamed({"j": "d"} | {f"j{x}": x for x in day})
    s = s.filter((F.col("d") >= F.greatest(F.col("known"), F.lit(HISTORY - 1))) & (F.col("d") <= F.col("until")))
    s = s.withColumn("now", line(F.col("d"))).withColumn("at_break", line(F.col("fb"))).withColumn("above", F.col("close") > F.col("now"))
    age = F.col("d") - F.col("fb")
    s = s.filter(F.when(F.col("above"), true((age >= 0) & (age <= q("max_age")) & (F.col("close") <= F.col("at_break") * (1 + q("max_runaway"))))).otherwise(
        (F.col("close") >= F.col("now") * (1 - q("watch_proximity"))) & (F.col("floor").isNull() | (F.col("close") > F.col("floor")))))
    if bars is not None:
        s = in_window(s, e, q, pattern, bars, table)
    # Trend rules of the day.
    if pattern == CUP:
        s = s.filter((F.col("decline_ok") | (q("cup_sma_or") & true(F.col("sma50") > F.col("sma200")))) & (~q("cup_above_sma200") | F.col("uptrend")))
    else:
        either = F.lit(False) if pattern == WOLFE else q({IHS: "ihs_sma_or", DOUBLE: "db_sma_or"}[pattern])
        s = s.filter((F.col("decline_ok") | (either & true(F.col("sma50") < F.col("sma200")))) & (~q("veto_reversals") | ~F.col("strong_down")))
    loud = q("volume_confirm").isNull() | true(F.col("fb_vr") >= q("volume_confirm"))
    s = s.withColumn("vr", F.when(F.col("above"), F.col("fb_vr"))).withColumn("confirmed", F.col("above") & loud)
    s = s.withColumn("age", F.when(F.col("confirmed"), age)).withColumn("trigger", F.when(F.col("confirmed"), F.col("at_break")).otherwise(F.col("now") if pattern != CUP else F.col("v0")))
    s = s.withColumn("entry", F.when(F.col("confirmed") & (F.col("close") > F.col("trigger")), F.col("close")).otherwise(F.col("trigger"))).withColumn("stop", F.col("last_low") - 0.25 * F.col("last_atr"))
    s = s.filter("stop < entry").withColumn("risk", (F.col("entry") - F.col("stop")) / F.col("entry") * 100)
    s = s.filter(F.col("risk") <= q("max_risk_pct"))
    s = s.filter(_off(q("max_wait_bars"), F.col("confirmed") | (F.col("d") - F.col("last") <= q("max_wait_bars"))))
    if pattern == WOLFE:
        target = F.when((F.col("target_at") <= F.col("close") * (1 + q("ww_max_target_gain"))) & (F.col("target_at") > F.col("entry")), F.col("target_at"))
    else:
        target = F.col("entry") + F.coalesce("height", F.col("trigger") - F.col("target_at"))
    s = s.withColumn("target", target).withColumn("rr", F.when(F.col("target").isNotNull(), r((F.col("target") - F.col("entry")) / (F.col("entry") - F.col("stop")), 2)))
    s = s.filter(_off(q("min_reward_risk"), F.col("rr").isNull() | (F.col("rr") >= q("min_reward_risk"))))
    weight = 10 if pattern in (CUP, WOLFE) else 5
    score = F.col("score0") + weight * (1 - F.least(F.col("risk") / q("max_risk_pct"), F.lit(1.0))) + F.when(true(F.col("vr") >= 1.3), 5.0).otherwise(0.0)
    if pattern != CUP:
        score = score + F.when(F.col("uptrend"), 5.0).otherwise(0.0)
    s = s.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(r(score, 6)).cast("int")))).filter(F.col("score") >= q("min_score"))
    # A null multiple leaves the runaway limit.
    cap = F.least(F.col("trigger") * (1 + q("max_runaway")), F.col("stop") + q("max_buy_risk_mult") * (F.col("entry") - F.col("stop")))
    return s.select("symbol", "d", "day", "pattern", F.when(F.col("confirmed"), "CONFIRMED").otherwise("WATCHLIST").alias("status"), r(F.col("entry"), 2).alias("entry"), r(F.col("stop"), 2).alias("stop"),
                    r(F.col("risk"), 2).alias("risk_pct"), r(F.col("target"), 2).alias("target"), "score", F.col("close").alias("last_close"), F.col("age").cast("int").alias("bars_since_break"),
                    F.col("vr").alias("volume_ratio"), "trend", r(cap, 2).alias("max_buy"), F.col("rr").alias("reward_risk"), "cand", "last", r(F.col("trigger"), 2).alias("trigger"), "anchors",
                    *[x for x in VARIANT[:1] if x in s.columns])


def best(signals: DataFrame) -> DataFrame:
    """The best score of each symbol, bar, pattern and status; of equals the earliest candidate."""
    w = Window.partitionBy("symbol", "d", "pattern", "status", *[x for x in VARIANT if x in signals.columns]).orderBy(F.desc("score"), "cand")
    return signals.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def scan(e: DataFrame, rules: dict, patterns=PATTERNS, days: DataFrame | None = None, bars: int | None = None, mood: DataFrame | None = None) -> DataFrame:
    """The signals of ``patterns`` as of the bars of ``days``, or of every bar; with ``bars`` as scans of so many bars see
    them; with ``mood`` (symbol, idx, fear_greed) each
    has the symbol's reading of its bar."""
    # Candidates are few beside the bars; as tables they are found once and planned once.
    sums, table = written(summaries(e)), None
    if bars is not None:
        e, table = written(with_restarted_atr(e, rules["atr_len"])), written(extremes(e, max(rules["cup_prior_lookback"], rules["cup_advance_lookback"], 60) + 1))
    found = [states(written(candidates(e, rules, p, bars is not None)), e, Fixed(rules, p), p, days, bars, sums, table) for p in patterns]
    out = best(reduce(DataFrame.unionByName, found))
    return out if mood is None else out.join(mood.select("symbol", F.col("idx").alias("d"), "fear_greed"), ["symbol", "d"], "left")


def scan_variants(e: DataFrame, variants: dict[int, dict], pattern: str, sums: DataFrame) -> DataFrame:
    """The signals of one pattern as of every bar under each of ``variants`` (flat rules by number), told apart by ``variant``.

    The geometry that any of the rules lets through is found once; the rules are a table whose rows are applied to it.
    ``e`` has the panel columns of every variant (:func:`wickwork.functions.indicators.enrich_for`).
    """
    q, table = Joined(variants), rules_table(e.sparkSession, variants)
    return best(states(written(DETECTORS[pattern](e, q, table)), e, q, pattern, sums=sums))


def last_bars(e: DataFrame) -> DataFrame:
    return e.groupBy("symbol").agg(F.max("idx").alias("d"))
