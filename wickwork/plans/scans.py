"""Queries over bars, indicators and detectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickwork.functions import indicators as ind
from wickwork.functions.columns import r, ratio, series, trailing
from wickwork.functions.rules import CUP, DOUBLE, IHS, WOLFE, Fixed, patterns, profile
from wickwork.operators import detectors as det
from wickwork.plans import oracle as o
from wickwork.plans.registry import query
from wickwork.sources.bars import bars
from wickwork.sources.store import written

SIGNAL = [c.strip() for c in o.SIGNAL.split(",")]


def enriched(spark: SparkSession, sf_dir: str, rules: dict | None = None) -> DataFrame:
    """Bars with all indicators, as a table, since detectors join them several times."""
    return written(ind.enrich(bars(spark, sf_dir), rules or profile()))


def _b(body: str) -> str:
    return o.with_(o.BARS) + body


def _e(body: str, *more: str) -> str:
    return o.with_(o.BARS, o.enriched(profile()), *more) + body


@query(_b("SELECT symbol, day, idx, open, high, low, close, volume FROM bars WHERE day >= (SELECT max(day) FROM bars) - INTERVAL 2 YEAR"))
def bars_scan_period(spark, sf_dir):
    """The last two years of bars."""
    b = bars(spark, sf_dir)
    return b.join(b.agg(F.max("day").alias("newest")), F.col("day") >= F.add_months("newest", -24)).drop("newest")


@query(_e(f"SELECT symbol, idx, {o.r('tr', 6)} AS tr, {o.r('atr', 6)} AS atr FROM e"))
def atr14(spark, sf_dir):
    return ind.with_atr(bars(spark, sf_dir)).select("symbol", "idx", r(F.col("tr"), 6).alias("tr"), r(F.col("atr"), 6).alias("atr"))


@query(_e(f"SELECT symbol, idx, {o.r('sma50', 6)} AS sma50, {o.r('sma200', 6)} AS sma200 FROM e"))
def sma_50_200(spark, sf_dir):
    return ind.with_smas(bars(spark, sf_dir)).select("symbol", "idx", r(F.col("sma50"), 6).alias("sma50"), r(F.col("sma200"), 6).alias("sma200"))


@query(_e("SELECT symbol, idx, day, CASE WHEN piv_h THEN high END AS swing_high, CASE WHEN piv_l THEN low END AS swing_low FROM e WHERE piv_h OR piv_l"))
def swing_pivots(spark, sf_dir):
    p = ind.with_pivots(bars(spark, sf_dir)).filter("piv_h or piv_l")
    return p.select("symbol", "idx", "day", F.when(F.col("piv_h"), F.col("high")).alias("swing_high"), F.when(F.col("piv_l"), F.col("low")).alias("swing_low"))


@query(_e("SELECT symbol, idx, uptrend, strong_down, trend FROM e"))
def trend_context(spark, sf_dir):
    return enriched(spark, sf_dir).select("symbol", "idx", "uptrend", "strong_down", "trend")


@query(_e("SELECT symbol, idx, vr FROM e"))
def volume_ratio(spark, sf_dir):
    return ind.with_volume(bars(spark, sf_dir)).select("symbol", "idx", "vr")


@query(_e("SELECT symbol, idx, vz FROM e WHERE idx >= 2"))
def volume_z(spark, sf_dir):
    return ind.with_volume(bars(spark, sf_dir)).filter("idx >= 2").select("symbol", "idx", "vz")


@query(_e(f"""SELECT symbol, idx, {o.r('close/sma200 - 1', 4)} AS close_vs_sma200, {o.r('sma50/sma200 - 1', 4)} AS sma50_vs_sma200,
  {o.r('sma200/lag(sma200, 40) OVER (PARTITION BY symbol ORDER BY idx) - 1', 4)} AS sma200_slope, {o.r('(close - sma200)/atr', 3)} AS dist_sma200_atr FROM e"""))
def trend_features(spark, sf_dir):
    e = enriched(spark, sf_dir).withColumn("then", F.lag("sma200", 40).over(series()))
    c, s = F.col("close"), F.col("sma200")
    return e.select("symbol", "idx", r(c / s - 1, 4).alias("close_vs_sma200"), r(F.col("sma50") / s - 1, 4).alias("sma50_vs_sma200"), r(s / F.col("then") - 1, 4).alias("sma200_slope"),
                    ratio(c - s, F.col("atr"), 3).alias("dist_sma200_atr"))


@query(_b(f"""SELECT symbol, idx, CASE WHEN n = 20 AND sd > 0 THEN {o.r('(close - (m - 2*sd))/(4*sd)', 3)} END AS pctb FROM
  (SELECT *, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING))"""))
def bollinger_pctb(spark, sf_dir):
    return ind.with_bollinger(bars(spark, sf_dir)).select("symbol", "idx", r(F.col("pctb"), 3).alias("pctb"))


_RSI = """RECURSIVE {bars},
g AS (SELECT symbol, idx, close - lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS d, close FROM bars),
h AS (SELECT symbol, idx, greatest(d, 0.0) AS gain, greatest(-d, 0.0) AS loss FROM g),
rs AS (SELECT symbol, CAST(14 AS INT) AS idx, avg(gain) AS ag, avg(loss) AS al FROM h WHERE idx BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT h.symbol, h.idx, (ag*13 + gain)/14, (al*13 + loss)/14 FROM rs JOIN h ON h.symbol = rs.symbol AND h.idx = rs.idx + 1),
rsi AS (SELECT symbol, idx, CASE WHEN ag = 0 AND al = 0 THEN 50.0 WHEN al = 0 THEN 100.0 ELSE {r} END AS rsi FROM rs)"""
_MACD = """,
ms AS (SELECT symbol, idx, close AS f, close AS s, CAST(0 AS DOUBLE) AS n FROM bars WHERE idx = 0
  UNION ALL SELECT b.symbol, b.idx, f*(1 - 2.0::DOUBLE/13) + b.close*2.0::DOUBLE/13, s*(1 - 2.0::DOUBLE/27) + b.close*2.0::DOUBLE/27,
    n*0.8::DOUBLE + 0.2::DOUBLE*((f*(1 - 2.0::DOUBLE/13) + b.close*2.0::DOUBLE/13) - (s*(1 - 2.0::DOUBLE/27) + b.close*2.0::DOUBLE/27)) FROM ms JOIN bars b ON b.symbol = ms.symbol AND b.idx = ms.idx + 1),
mh AS (SELECT symbol, idx, f - s - n AS hist_all FROM ms)"""
_RANK = """,
mr AS (SELECT x.symbol, x.idx, (sum(CASE WHEN {h}y < {h}x THEN 1.0 WHEN {h}y = {h}x THEN 0.5 ELSE 0.0 END))/count(*)*100 AS raw FROM
  (SELECT symbol, idx, {r} AS hx FROM mh) x JOIN (SELECT symbol, idx, {r} AS hy FROM mh) y ON x.symbol = y.symbol AND y.idx BETWEEN x.idx - 249 AND x.idx WHERE x.idx >= 34 GROUP BY 1, 2)"""
_RSI_CTE = _RSI.format(bars=o.BARS, r=o.r("100 - 100/(1 + ag/al)", 2))
_RANK_CTE = _RANK.format(h="h", r=o.r("hist_all", 6))


@query("WITH " + _RSI_CTE + f" SELECT b.symbol, b.idx, {o.r('rsi', 1)} AS rsi FROM bars b LEFT JOIN rsi USING (symbol, idx)")
def rsi14(spark, sf_dir):
    return ind.with_rsi(bars(spark, sf_dir)).select("symbol", "idx", r(F.col("rsi"), 1).alias("rsi"))


@query("WITH " + _RSI_CTE + _MACD + f" SELECT symbol, idx, {o.r('hist_all', 6)} AS hist FROM mh WHERE idx >= 34")
def macd_hist(spark, sf_dir):
    return ind.with_macd(bars(spark, sf_dir)).filter("idx >= 34").select("symbol", "idx", r(F.col("hist"), 6).alias("hist"))


@query("WITH " + _RSI_CTE + _MACD + _RANK_CTE + f" SELECT symbol, idx, {o.r('raw', 1)} AS macd_pct FROM mr")
def macd_midrank_pct(spark, sf_dir):
    return ind.with_midrank(ind.with_macd(bars(spark, sf_dir))).filter("idx >= 34").select("symbol", "idx", "macd_pct")


_FG = "WITH " + _RSI_CTE + _MACD + _RANK_CTE + f""",
bb AS (SELECT symbol, idx, CASE WHEN n = 20 AND sd > 0 THEN {o.r('(close - (m - 2*sd))/(4*sd)', 3)} END AS pctb FROM
  (SELECT *, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING))),
fg AS (SELECT bb.symbol, bb.idx, rsi, {o.r('raw', 1)} AS macd_pct, least(greatest(pctb*100, 0.0), 100.0) AS pb FROM bb LEFT JOIN rsi USING (symbol, idx) LEFT JOIN mr USING (symbol, idx)),
fgs AS (SELECT symbol, idx, CASE WHEN rsi IS NOT NULL OR macd_pct IS NOT NULL OR pb IS NOT NULL THEN
  {o.r('(coalesce(rsi, 0) + coalesce(macd_pct, 0) + coalesce(pb, 0))/((rsi IS NOT NULL)::INT + (macd_pct IS NOT NULL)::INT + (pb IS NOT NULL)::INT)', 1)} END AS fear_greed FROM fg)"""


@query(_FG + " SELECT symbol, idx, fear_greed FROM fgs")
def fear_greed(spark, sf_dir):
    return ind.with_fear_greed(bars(spark, sf_dir)).select("symbol", "idx", "fear_greed")


@query(_FG + """ SELECT CASE WHEN fear_greed < 20 THEN 'extreme fear' WHEN fear_greed < 40 THEN 'fear' WHEN fear_greed < 60 THEN 'neutral' WHEN fear_greed < 80 THEN 'greed' ELSE 'extreme greed' END AS zone, count(*) AS n
  FROM fgs WHERE fear_greed IS NOT NULL GROUP BY 1""")
def fear_greed_zone(spark, sf_dir):
    f = ind.with_fear_greed(bars(spark, sf_dir)).filter("fear_greed is not null")
    return f.groupBy(ind.fear_greed_zone(F.col("fear_greed")).alias("zone")).agg(F.count("*").alias("n"))


@query(_b("SELECT symbol, idx, max(high) OVER (PARTITION BY symbol ORDER BY idx ROWS 60 PRECEDING) AS hi60, min(low) OVER (PARTITION BY symbol ORDER BY idx ROWS 250 PRECEDING) AS low250 FROM bars"))
def lookback_extremes(spark, sf_dir):
    e = enriched(spark, sf_dir)
    return e.select("symbol", "idx", "hi60", F.col("low_advance").alias("low250"))


_PAIRS = "lw AS (SELECT symbol, idx AS a, lead(idx) OVER (PARTITION BY symbol ORDER BY idx) AS b FROM e WHERE piv_l)"


@query(_e("SELECT c.symbol, a, b, x.idx AS top, x.high AS top_high FROM lw c JOIN e x ON x.symbol = c.symbol AND x.idx > a AND x.idx < b QUALIFY row_number() OVER (PARTITION BY c.symbol, a ORDER BY x.high DESC, x.idx) = 1", _PAIRS))
def interval_argmin(spark, sf_dir):
    """The first highest bar between consecutive swing lows."""
    e = enriched(spark, sf_dir)
    c = e.filter("piv_l").select("symbol", F.col("idx").alias("a"), F.lead("idx").over(series()).alias("b")).filter("b is not null")
    c = det.interval(c, e, F.col("a") + 1, F.col("b") - 1, F.max(F.struct("jhigh", (-F.col("j")).alias("i"))).alias("m"))
    return c.select("symbol", "a", "b", (-F.col("m.i")).alias("top"), F.col("m.jhigh").alias("top_high"))


def _candidates(pattern, cte):
    sql = _e(f"SELECT symbol, cand, known, start, {o.r('v0', 4)} AS v0, {o.r('slope', 6)} AS slope, last, {o.r('last_low', 2)} AS last_low, {o.r('height', 4)} AS height, {o.r('score0', 4)} AS score0, decline_ok FROM {cte}", o.CANDIDATES[pattern][0](profile()))

    def run(spark, sf_dir):
        rules = profile()
        c = det.candidates(enriched(spark, sf_dir, rules), rules, pattern)
        return c.select("symbol", "cand", "known", "start", r(F.col("v0"), 4).alias("v0"), r(F.col("slope"), 6).alias("slope"), "last", r(F.col("last_low"), 2).alias("last_low"), r(F.col("height"), 4).alias("height"),
                        r(F.col("score0"), 4).alias("score0"), "decline_ok")

    return sql, run


for _p, _n, _c in ((CUP, "cup", "cand_cup"), (IHS, "ihs", "cand_ihs"), (DOUBLE, "db", "cand_db"), (WOLFE, "wolfe", "cand_ww")):
    query(_candidates(_p, _c)[0], name=f"candidates_{_n}")(_candidates(_p, _c)[1])


def _fits():
    return _e(f"SELECT symbol, a, b, {o.r('u', 6)} AS u FROM fit_u", o.cup_pairs(profile()), o.cup_fits()), _e(f"SELECT symbol, a, b, {o.r('v', 6)} AS v FROM fit_v", o.cup_pairs(profile()), o.cup_fits())


@query(_fits()[0])
def cup_u_shape_r2(spark, sf_dir):
    e = enriched(spark, sf_dir)
    return det.u_shape(det.cup_pairs(e, Fixed(profile(), CUP)), e).select("symbol", "a", "b", r(F.col("u"), 6).alias("u"))


@query(_fits()[1])
def cup_v_shape_r2(spark, sf_dir):
    e = enriched(spark, sf_dir)
    return det.v_shape(det.cup_pairs(e, Fixed(profile(), CUP)).select("symbol", "a", "b", "bi"), e).select("symbol", "a", "b", r(F.col("v"), 6).alias("v"))


@query(_e("SELECT symbol, a, b, j AS \"end\", hh, hl, hi_ AS hl_i, j = final_end AS final FROM hl", o.cup_handle(profile())))
def cup_handle(spark, sf_dir):
    e = enriched(spark, sf_dir)
    rules = profile()
    q = Fixed(rules, CUP)
    return det.handles(e, det.rounded(det.cup_pairs(e, q), e, q)).select("symbol", "a", "b", "end", "hh", "hl", "hl_i", (F.col("until") == 2**30).alias("final"))


def _signals(pattern, prof):
    sql = o.with_(o.BARS, *o.detector(pattern, prof)) + f"SELECT {o.SIGNAL} FROM sig"

    def run(spark, sf_dir):
        rules = profile(prof)
        return det.scan(enriched(spark, sf_dir, rules), rules, (pattern,)).select(*SIGNAL)

    return sql, run


for _p, _n in ((CUP, "cup_handle"), (IHS, "inverse_hs"), (DOUBLE, "double_bottom"), (WOLFE, "wolfe")):
    query(_signals(_p, "spec")[0], name=f"detect_{_n}")(_signals(_p, "spec")[1])


@query(o.with_(o.BARS, o.scan_all("tuned")) + f"SELECT {o.SIGNAL} FROM allsig WHERE status = 'CONFIRMED'")
def scan_all_patterns(spark, sf_dir):
    """Flagship: the confirmed signals of all four patterns as of every bar, tuned rules."""
    rules = profile("tuned")
    return det.scan(enriched(spark, sf_dir, rules), rules).filter("status = 'CONFIRMED'").select(*SIGNAL)


@query(o.with_(o.BARS, o.scan_all("tuned", "x.idx = (SELECT max(idx) FROM e z WHERE z.symbol = x.symbol)")) + f"SELECT {o.SIGNAL} FROM allsig")
def scan_last_bar(spark, sf_dir):
    """The nightly scan: all patterns as of each symbol's last bar."""
    rules = profile("tuned")
    e = enriched(spark, sf_dir, rules)
    return det.scan(e, rules, days=det.last_bars(e)).select(*SIGNAL)


@query(o.with_(o.BARS, o.enriched(profile("tuned")), o.double_bottom(profile("tuned")), o.signals(profile("tuned"), DOUBLE, "s1_"), o.inverse_hs(profile("tuned")).replace(f"\n{o._lows()},", ""), o.signals(profile("tuned"), IHS, "s2_"))
       + f"SELECT {o.SIGNAL} FROM s1_ UNION ALL SELECT {o.SIGNAL} FROM s2_")
def detector_subset(spark, sf_dir):
    """Detectors chosen by alias."""
    rules = profile("tuned")
    return det.scan(enriched(spark, sf_dir, rules), rules, patterns("db, ihs")).select(*SIGNAL)


@query(_e(f"""SELECT c.symbol, c.cand, min(y.idx) AS first_break FROM cand_ihs c LEFT JOIN e y ON y.symbol = c.symbol AND y.idx >= c.start AND y.close > v0 + slope*(y.idx - i0) GROUP BY 1, 2""", o.inverse_hs(profile())))
def breakout_state(spark, sf_dir):
    """The first close above each sloping neckline."""
    e = enriched(spark, sf_dir)
    return det.breakouts(det.candidates(e, profile(), IHS), e).select("symbol", "cand", F.col("fb").alias("first_break"))
