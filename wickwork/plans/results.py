"""Queries over market context, cleaning, membership and outcomes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.functions import indicators as ind
from wickwork.functions.columns import r, series
from wickwork.functions.rules import CUP, DOUBLE, IHS, WOLFE, profile
from wickwork.operators import cleaning, market, outcomes
from wickwork.plans import oracle as o
from wickwork.plans.registry import query
from wickwork.plans.scans import enriched
from wickwork.sources import bars as src
from wickwork.sources.store import written

E = o.enriched(profile())
MARKET = f"""{o.INDEX},{o.VOL},
br AS (SELECT day, count(sma200) AS breadth_symbols, CASE WHEN count(sma200) > 0 THEN {o.r("count(*) FILTER (WHERE close > sma200) / CAST(count(sma200) AS DOUBLE)", 4)} END AS breadth FROM e GROUP BY day),
ia AS (SELECT *, CASE WHEN idx >= 199 THEN {o.mean('close', 'OVER (ORDER BY day ROWS 199 PRECEDING)')} END AS s200, CASE WHEN idx >= 49 THEN {o.mean('close', 'OVER (ORDER BY day ROWS 49 PRECEDING)')} END AS s50 FROM index_bars),
ir AS (SELECT day, {o.r("close", 2)} AS index_close, {o.r("(close/s200 - 1)*100", 2)} AS index_vs_sma200_pct, {o.r("(s50/s200 - 1)*100", 2)} AS index_sma50_vs_sma200_pct,
  CASE WHEN s200 IS NULL THEN NULL WHEN close > s200 AND s50 > s200 THEN 'bull' WHEN close < s200 AND s50 < s200 THEN 'bear' ELSE 'neutral' END AS regime FROM ia),
vb AS (SELECT day, {o.r("close", 2)} AS vix FROM vol_bars),
market AS (SELECT * FROM br FULL JOIN ir USING (day) FULL JOIN vb USING (day))"""
_MCOLS = "day, breadth_symbols, breadth, index_close, index_vs_sma200_pct, index_sma50_vs_sma200_pct, regime, vix"


def market_table(spark, sf_dir, e=None):
    return market.market_series(e if e is not None else enriched(spark, sf_dir), src.index_bars(spark, sf_dir), src.vol_bars(spark, sf_dir))


@query(o.with_(o.BARS, E, MARKET) + "SELECT * FROM br")
def breadth(spark, sf_dir):
    return market.breadth(enriched(spark, sf_dir))


@query(o.with_(o.INDEX, f"""ia AS (SELECT *, CASE WHEN idx >= 199 THEN {o.mean('close', 'OVER (ORDER BY day ROWS 199 PRECEDING)')} END AS s200, CASE WHEN idx >= 49 THEN {o.mean('close', 'OVER (ORDER BY day ROWS 49 PRECEDING)')} END AS s50 FROM index_bars)""")
       + f"""SELECT day, {o.r("close", 2)} AS index_close, {o.r("(close/s200 - 1)*100", 2)} AS index_vs_sma200_pct, {o.r("(s50/s200 - 1)*100", 2)} AS index_sma50_vs_sma200_pct,
  CASE WHEN s200 IS NULL THEN NULL WHEN close > s200 AND s50 > s200 THEN 'bull' WHEN close < s200 AND s50 < s200 THEN 'bear' ELSE 'neutral' END AS regime FROM ia""")
def market_regime(spark, sf_dir):
    return market.regime(src.index_bars(spark, sf_dir))


@query(o.with_(o.BARS, E, MARKET) + f"SELECT {_MCOLS} FROM market")
def market_series(spark, sf_dir):
    return market_table(spark, sf_dir).select(*_MCOLS.split(", "))


_ASOF = ", ".join(f"(SELECT max_by({c}, day) FROM market m WHERE m.day <= x.day AND {c} IS NOT NULL) AS {c}" for c in ("regime", "vix", "breadth", "index_vs_sma200_pct"))


@query(o.with_(o.BARS, E, MARKET) + f"SELECT symbol, day, {_ASOF} FROM bars x")
def market_asof(spark, sf_dir):
    """The market at every bar; each series at its own last date."""
    e = enriched(spark, sf_dir)
    rows = e.select("symbol", "day")
    return market.as_of(rows, "day", market_table(spark, sf_dir, e), ("regime", "vix", "breadth", "index_vs_sma200_pct"))


_FORCE = "force AS (SELECT d.day, coalesce((SELECT max(snapshot_date) FROM snapshots s WHERE s.snapshot_date <= d.day), (SELECT min(snapshot_date) FROM snapshots)) AS snapshot_date FROM (SELECT DISTINCT day FROM bars) d)"


@query(o.with_(o.BARS, o.SNAPSHOTS, _FORCE) + "SELECT day, count(*) AS members, min(symbol) AS lowest, sum(symbol) AS total FROM force JOIN snapshots USING (snapshot_date) GROUP BY day")
def membership_asof(spark, sf_dir):
    m = market.members(src.bars(spark, sf_dir).select("day").distinct(), src.membership_snapshots(spark, sf_dir))
    return m.groupBy("day").agg(F.count("*").alias("members"), F.min("symbol").alias("lowest"), F.sum("symbol").alias("total"))


@query(o.with_(o.SNAPSHOTS, """sn AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS no, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt FROM (SELECT DISTINCT snapshot_date FROM snapshots)),
sm AS (SELECT symbol, no, snapshot_date, nxt, CASE WHEN lag(no) OVER (PARTITION BY symbol ORDER BY no) = no - 1 THEN 0 ELSE 1 END AS fresh FROM snapshots JOIN sn USING (snapshot_date)),
si AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY no) AS island FROM sm)""") + """SELECT symbol, CASE WHEN min(no) = 1 THEN DATE '0001-01-01' ELSE min(snapshot_date) END AS valid_from, CASE WHEN bool_or(nxt IS NULL) THEN DATE '9999-12-31' ELSE CAST(max(nxt) AS DATE) - 1 END AS valid_to FROM
  (SELECT symbol, island, no, snapshot_date, nxt FROM si) GROUP BY symbol, island""")
def membership_intervals(spark, sf_dir):
    """Snapshots as stretches of membership."""
    return market.intervals(src.membership_snapshots(spark, sf_dir))


@query(o.with_(o.BARS, o.SNAPSHOTS, _FORCE) + "SELECT DISTINCT symbol FROM force JOIN snapshots USING (snapshot_date)")
def membership_union(spark, sf_dir):
    return market.members(src.bars(spark, sf_dir).select("day").distinct(), src.membership_snapshots(spark, sf_dir)).select("symbol").distinct()


@query(o.with_(o.BARS, o.SNAPSHOTS, _FORCE) + f"""SELECT CAST(year(day) AS INT) AS year, count(DISTINCT symbol) AS members, count(DISTINCT CASE WHEN symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 290) THEN symbol END) AS with_data,
  {o.r("count(DISTINCT CASE WHEN symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 290) THEN symbol END) / CAST(count(DISTINCT symbol) AS DOUBLE)", 3)} AS share FROM force JOIN snapshots USING (snapshot_date) GROUP BY 1""")
def membership_coverage(spark, sf_dir):
    """Members per year and how many of them have a long history."""
    b = src.bars(spark, sf_dir)
    has = b.groupBy(F.col("symbol").alias("have")).agg(F.count("*").alias("n")).filter("n >= 290").drop("n")
    m = market.members(b.select("day").distinct(), src.membership_snapshots(spark, sf_dir)).select(F.year("day").alias("year"), "symbol").distinct().join(has, F.col("symbol") == F.col("have"), "left")
    return m.groupBy("year").agg(F.count("*").alias("members"), F.count("have").alias("with_data"), r(F.count("have") / F.count("*"), 3).alias("share"))


# Cleaning -----------------------------------------------------------------------------------------------------------------

_NAMES = "CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN ' nan ' WHEN s_suppkey % 5 = 2 THEN ' ' || lower(replace(s_name, '#', '.')) ELSE s_name END"


@query(f"SELECT DISTINCT upper(replace(trim(x), '.', '-')) AS symbol FROM (SELECT {_NAMES} AS x FROM supplier) WHERE x IS NOT NULL AND upper(trim(x)) NOT IN ('', 'NAN')")
def universe_normalise(spark, sf_dir):
    text = src.table(spark, sf_dir, "supplier").select(F.expr(_NAMES).alias("symbol"))
    return cleaning.symbols(text)


@query(o.with_(o.BARS) + "SELECT symbol, count(*) AS bars FROM bars WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) GROUP BY symbol")
def universe_semi_join(spark, sf_dir):
    wanted = src.table(spark, sf_dir, "supplier").filter("s_nationkey < 10").select(F.col("s_suppkey").cast("long").alias("symbol"))
    return src.bars(spark, sf_dir).join(wanted, "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("bars"))


@query(o.with_(o.BARS, o.RAW) + "SELECT symbol, day, " + ", ".join(o.r(f"{c}*coalesce(adj_close/close, 1.0)", 6) + f" AS {c}" for c in cleaning.PRICES) + ", volume FROM raw")
def adjust_ohlc(spark, sf_dir):
    a = cleaning.adjust_ohlc(src.raw_bars(spark, sf_dir))
    return a.select("symbol", "day", *[r(F.col(c), 6).alias(c) for c in cleaning.PRICES], "volume")


_FILL = """ok AS (SELECT w.*, q.price, w.day = max(w.day) OVER (PARTITION BY w.symbol) AND w.close IS NULL AND q.price > 0 AND q.traded_day = w.day AND w.day + INTERVAL 21 HOUR + INTERVAL 1 HOUR <= TIMESTAMP '2030-01-01' AS f
  FROM raw w LEFT JOIN quotes q USING (symbol)),
filled AS (SELECT symbol, day, CASE WHEN f THEN coalesce(open, price) ELSE open END AS open, CASE WHEN f THEN CASE WHEN high IS NULL THEN price ELSE greatest(high, price) END ELSE high END AS high,
  CASE WHEN f THEN CASE WHEN low IS NULL THEN price ELSE least(low, price) END ELSE low END AS low, CASE WHEN f THEN price ELSE close END AS close, volume, coalesce(f, false) AS filled FROM ok)"""


@query(o.with_(o.BARS, o.RAW, o.QUOTES, _FILL) + "SELECT symbol, day, open, high, low, close, volume, filled FROM filled")
def fill_missing_close(spark, sf_dir):
    f = cleaning.fill_missing_close(src.raw_bars(spark, sf_dir), src.quotes(spark, sf_dir), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return f.select("symbol", "day", "open", "high", "low", "close", "volume", "filled")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE epoch(o_orderdate)::BIGINT END AS seconds FROM orders")
def as_utc(spark, sf_dir):
    """Trade times given as epoch seconds, as timestamp texts, or unreadable."""
    t = src.table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.unix_timestamp("o_orderdate").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderdate").cast("string")).otherwise("soon")
    return t.select("o_orderkey", F.unix_timestamp(cleaning.as_utc(text)).alias("seconds"))


@query(o.with_(o.BARS, o.RAW) + """SELECT symbol, last_ok, array_to_string(list_sort(list(CASE WHEN day > last_ok THEN CAST(day AS VARCHAR) END) FILTER (WHERE day > last_ok)), ',') AS partial
  FROM (SELECT *, max(CASE WHEN close IS NOT NULL THEN day END) OVER (PARTITION BY symbol) AS last_ok FROM raw) GROUP BY symbol, last_ok HAVING count(*) FILTER (WHERE day > last_ok) > 0""")
def partial_bars(spark, sf_dir):
    p = cleaning.partial_bars(src.raw_bars(spark, sf_dir)).filter(F.size("partial") > 0)
    return p.select("symbol", "last_ok", F.array_join("partial", ",").alias("partial"))


@query(o.with_(o.BARS, o.RAW) + "SELECT symbol, count(*) AS bars FROM raw WHERE close IS NOT NULL GROUP BY symbol HAVING count(*) >= 290")
def min_history(spark, sf_dir):
    """Symbols with at least 290 whole bars."""
    return cleaning.complete(src.raw_bars(spark, sf_dir), 290).groupBy("symbol").agg(F.count("*").alias("bars"))


_HIST = "lastd AS (SELECT symbol, max(day) AS day FROM bars GROUP BY symbol), hist AS (SELECT day, count(*) AS symbols FROM lastd GROUP BY day), lb AS (SELECT max(day) AS last_bar FROM hist h WHERE (SELECT sum(symbols) FROM hist g WHERE g.day >= h.day) >= 0.5*(SELECT count(*) FROM lastd))"


@query(o.with_(o.BARS, _HIST) + "SELECT day, symbols FROM hist")
def last_bar_histogram(spark, sf_dir):
    return cleaning.histogram(src.bars(spark, sf_dir))


@query(o.with_(o.BARS, _HIST) + "SELECT symbol, count(*) AS bars, max(day) AS last_day FROM bars, lb WHERE day <= last_bar GROUP BY symbol")
def align_last_bar(spark, sf_dir):
    return cleaning.align(src.bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("day").alias("last_day"))


@query(o.with_(o.BARS, _HIST, "ah AS (SELECT day, count(*) AS c FROM bars, lb WHERE day > last_bar GROUP BY day)", """pt AS (SELECT x.day FROM (SELECT *, max(day) OVER (PARTITION BY symbol) AS nd FROM bars) x, lb WHERE x.day = nd AND (symbol % 7 = 0 OR symbol % 11 = 0) AND x.day > last_bar)""")
       + """SELECT last_bar, (SELECT count(*) FROM lastd, lb WHERE day >= last_bar) AS last_bar_symbols, (SELECT count(*) FROM lastd, lb WHERE day < last_bar) AS lagging_symbols,
  (SELECT max(day) FROM ah) AS skipped_bar, coalesce((SELECT c FROM ah ORDER BY day DESC LIMIT 1), 0) AS skipped_bar_complete FROM lb""")
def align_last_bar_info(spark, sf_dir):
    b = src.bars(spark, sf_dir)
    nothing = b.limit(0).select("symbol", F.array(F.col("day").cast("string")).alias("partial"))
    return cleaning.align_info(b, nothing).drop("skipped_bar_partial")


@query(o.with_(o.BARS, o.RAW) + """SELECT symbol, max(day) AS raw_last, max_by(concat_ws(',', CASE WHEN open IS NULL THEN 'open' END, CASE WHEN high IS NULL THEN 'high' END, CASE WHEN low IS NULL THEN 'low' END, CASE WHEN close IS NULL THEN 'close' END), day) AS missing,
  max(CASE WHEN close IS NOT NULL THEN day END) AS last_ok FROM raw GROUP BY symbol""")
def last_bar_null_profile(spark, sf_dir):
    return cleaning.null_profile(src.raw_bars(spark, sf_dir))


@query("SELECT o_orderkey, CAST(CASE WHEN h >= 21 THEN d ELSE d - 1 END AS DATE) AS cutoff FROM (SELECT o_orderkey, o_orderkey % 24 AS h, CAST(o_orderdate AS DATE) AS d FROM orders)")
def session_cutoff(spark, sf_dir):
    t = src.table(spark, sf_dir, "orders")
    now = F.date_trunc("day", "o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return t.select("o_orderkey", cleaning.session_cutoff(now).alias("cutoff"))


@query(o.with_(o.BARS) + "SELECT count(*) AS universe, count(b.symbol) AS scanned, count(*) - count(b.symbol) AS errors FROM supplier LEFT JOIN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 290) b ON b.symbol = s_suppkey")
def scan_error_accounting(spark, sf_dir):
    ok = src.bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")).filter("n >= 290")
    u = src.table(spark, sf_dir, "supplier").join(ok, F.col("s_suppkey") == F.col("symbol"), "left")
    return u.agg(F.count("*").alias("universe"), F.count("symbol").alias("scanned"), (F.count("*") - F.count("symbol")).alias("errors"))


# Outcomes -----------------------------------------------------------------------------------------------------------------

POS = f"""{MARKET},
pos0 AS (SELECT symbol, idx AS d, day AS scan_day, CASE idx % 4 WHEN 0 THEN '{CUP}' WHEN 1 THEN '{IHS}' WHEN 2 THEN '{DOUBLE}' ELSE '{WOLFE}' END AS pattern, CAST(60 + (symbol*7 + idx) % 41 AS INT) AS score, close AS entry,
  {o.r("low - 0.25*atr", 2)} AS stop, {o.r("close*1.05", 2)} AS max_buy, atr, low AS cup_bottom, close AS cup_trigger FROM e WHERE idx >= 60),
pos AS (SELECT *, CASE WHEN symbol % 10 <> 9 THEN {o.r("entry + 2*(entry - stop)", 2)} END AS target, (SELECT max_by(regime, day) FROM market m WHERE m.day <= scan_day AND regime IS NOT NULL) AS regime FROM pos0)"""
# First hit per position over 40 bars: the stop is looked at before the target.
FATE = f"""
fw AS (SELECT p.*, x.idx AS j, x.day AS jday, x.open AS o_, x.high AS h_, x.low AS l_, x.close AS c_ FROM pos p LEFT JOIN bars x ON x.symbol = p.symbol AND x.idx > p.d AND x.idx <= p.d + 40),
f1 AS (SELECT symbol, d, pattern, count(j) AS n, min(CASE WHEN l_ <= stop THEN j END) AS js, min(CASE WHEN h_ >= target THEN j END) AS jt, min_by(o_, j) AS fill, min(jday) AS fill_day, max_by(c_, j) AS lc, max(jday) AS ld FROM fw GROUP BY symbol, d, pattern),
f2 AS (SELECT *, CASE WHEN n = 0 THEN 'no_data' WHEN js IS NULL AND jt IS NULL THEN 'open' WHEN jt IS NULL OR js <= jt THEN 'stop' ELSE 'target' END AS o1 FROM f1),
f3 AS (SELECT p.*, f2.n, f2.fill, f2.fill_day, o1, CASE o1 WHEN 'stop' THEN least(x.open, stop) WHEN 'target' THEN greatest(x.open, target) WHEN 'open' THEN lc END AS x1,
  CASE o1 WHEN 'stop' THEN js - p.d WHEN 'target' THEN jt - p.d ELSE n END AS b1, CASE WHEN o1 IN ('stop', 'target') THEN x.day ELSE ld END AS d1
  FROM pos p JOIN f2 ON p.symbol = f2.symbol AND p.d = f2.d AND p.pattern = f2.pattern LEFT JOIN bars x ON x.symbol = p.symbol AND x.idx = CASE o1 WHEN 'stop' THEN js WHEN 'target' THEN jt END),
f4 AS (SELECT *, CASE WHEN o1 = 'no_data' THEN o1 WHEN fill > max_buy THEN 'gap' WHEN fill <= stop THEN 'below_stop' ELSE o1 END AS outcome FROM f3),
f5 AS (SELECT *, CASE WHEN outcome IN ('stop', 'target', 'open') THEN x1 END AS exit, CASE WHEN outcome IN ('stop', 'target', 'open') THEN b1 ELSE 0 END AS bars,
  CASE WHEN outcome IN ('stop', 'target', 'open') THEN (x1 - fill)/(fill - stop) END AS r, CASE WHEN outcome IN ('stop', 'target', 'open') THEN d1 END AS exit_day FROM f4),
ex AS (SELECT w.symbol, w.d, w.pattern, max(h_) AS mh, min(l_) AS ml, min(CASE WHEN h_ >= fill*1.05 THEN j END) AS ju, min(CASE WHEN c_ < w.stop THEN j END) AS jd FROM fw w JOIN f5 ON f5.symbol = w.symbol AND f5.d = w.d AND f5.pattern = w.pattern GROUP BY w.symbol, w.d, w.pattern),
fate AS (SELECT f5.*, CASE WHEN r IS NULL THEN NULL ELSE {o.r("mh/fill - 1", 4)} END AS mfe, CASE WHEN r IS NULL THEN NULL ELSE {o.r("ml/fill - 1", 4)} END AS mae,
  CASE WHEN r IS NULL THEN NULL WHEN ju IS NOT NULL AND (jd IS NULL OR ju <= jd) THEN true WHEN jd IS NOT NULL THEN false END AS success5 FROM f5 LEFT JOIN ex ON f5.symbol = ex.symbol AND f5.d = ex.d AND f5.pattern = ex.pattern)"""
_SUMMARY = f"""count(*) AS n, {", ".join(f"count(*) FILTER (WHERE outcome = '{x}') AS {'open' if x == 'open' else x}" for x in ("target", "stop", "open", "expired", "gap", "below_stop", "no_data"))},
  CASE WHEN count(*) FILTER (WHERE outcome IN ('target', 'stop')) > 0 THEN {o.r("count(*) FILTER (WHERE outcome = 'target')/CAST(count(*) FILTER (WHERE outcome IN ('target', 'stop')) AS DOUBLE)", 3)} END AS hit_rate"""
_MEANS = f"{o.r('avg(r) FILTER (WHERE r IS NOT NULL)', 3)} AS mean_r, {o.r('sum(r)', 2)} AS total_r"
_STATS = (_SUMMARY.replace("count(*) AS n,", "count(*) AS signals,", 1) + f", {o.r('avg(r)', 3)} AS mean_r, {o.r('quantile_cont(r, 0.5)', 3)} AS median_r, {o.r('stddev_samp(r)', 3)} AS std_r, {o.r('sum(r)', 2)} AS total_r, "
          f"{o.r('avg(CASE WHEN success5 THEN 1.0 WHEN NOT success5 THEN 0.0 END)', 3)} AS success5, {o.r('CAST(sum(CAST(round(mfe*1e4) AS BIGINT)) AS DOUBLE)/(count(mfe)*1e4)', 4)} AS mfe, {o.r('CAST(sum(CAST(round(mae*1e4) AS BIGINT)) AS DOUBLE)/(count(mae)*1e4)', 4)} AS mae")


def positions(spark, sf_dir, e=None):
    """A trade on every bar, independent of the detectors: many rows that reach every case of the accounting."""
    e = enriched(spark, sf_dir) if e is None else e
    p = e.filter("idx >= 60")
    pattern = F.element_at(F.array(*map(F.lit, (CUP, IHS, DOUBLE, WOLFE))), (F.col("idx") % 4 + 1).cast("int"))
    p = p.select("symbol", F.col("idx").alias("d"), F.col("day").alias("scan_day"), pattern.alias("pattern"), (60 + (F.col("symbol") * 7 + F.col("idx")) % 41).cast("int").alias("score"), F.col("close").alias("entry"),
                 r(F.col("low") - 0.25 * F.col("atr"), 2).alias("stop"), r(F.col("close") * 1.05, 2).alias("max_buy"), "atr", F.col("low").alias("cup_bottom"), F.col("close").alias("cup_trigger"))
    p = p.withColumn("target", F.when(F.col("symbol") % 10 != 9, r(F.col("entry") + 2 * (F.col("entry") - F.col("stop")), 2)))
    return market.as_of(p, "scan_day", market.regime(src.index_bars(spark, sf_dir)).select("day", "regime"), ("regime",))


def fates(spark, sf_dir, horizon=40):
    """Positions with outcome and excursions; of the indicators they need one."""
    e = written(ind.with_atr(src.bars(spark, sf_dir), profile()["atr_len"]).select("symbol", "idx", *outcomes.PATH, "atr"))
    return outcomes.scored(positions(spark, sf_dir, e), e, horizon)


def _pos(body, *more):
    return o.with_(o.BARS, E, POS, *more) + body


@query(_pos(f"SELECT symbol, d, pattern, o1 AS outcome, {o.r('x1', 4)} AS exit, CAST(b1 AS INT) AS bars, CASE WHEN fill > stop THEN {o.r('(x1 - fill)/(fill - stop)', 4)} END AS r FROM f3", FATE))
def classify_outcome(spark, sf_dir):
    e = enriched(spark, sf_dir)
    f = outcomes.resolve(positions(spark, sf_dir, e), e, 40)
    return f.select("symbol", "d", "pattern", "outcome", r(F.col("exit"), 4).alias("exit"), "bars", r(F.col("r"), 4).alias("r"))


@query(_pos(f"SELECT symbol, d, outcome, {o.r('fill', 2)} AS fill, {o.r('exit', 4)} AS exit, CAST(bars AS INT) AS bars, {o.r('r', 4)} AS r FROM fate", FATE))
def fill_and_classify(spark, sf_dir):
    f = fates(spark, sf_dir)
    return f.select("symbol", "d", "outcome", r(F.col("fill"), 2).alias("fill"), r(F.col("exit"), 4).alias("exit"), "bars", r(F.col("r"), 4).alias("r"))


@query(_pos(f"SELECT symbol, d, fill_day, exit_day, CASE WHEN outcome = 'open' AND n >= 40 THEN 'expired' ELSE outcome END AS outcome, {o.r('(exit/fill - 1)*100', 2)} AS pnl_pct FROM fate", FATE))
def evaluate_log(spark, sf_dir):
    """The track record's accounting: unresolved positions of a whole horizon expire."""
    e = enriched(spark, sf_dir)
    f = outcomes.fill_and_resolve(positions(spark, sf_dir, e), e, 40, expire=True)
    return f.select("symbol", "d", "fill_day", "exit_day", "outcome", r((F.col("exit") / F.col("fill") - 1) * 100, 2).alias("pnl_pct"))


@query(_pos(f"SELECT p.symbol, p.d, count(x.idx) AS bars, max(x.high) AS top, min(x.low) AS bottom FROM pos p LEFT JOIN bars x ON x.symbol = p.symbol AND x.idx > p.d AND x.idx <= p.d + 20 GROUP BY 1, 2"))
def signal_forward_bars(spark, sf_dir):
    """The 20 bars after each signal."""
    e = enriched(spark, sf_dir)
    p = positions(spark, sf_dir, e).select("symbol", "d")
    return outcomes.paths(p, e, 20).select("symbol", "d", outcomes.seen().cast("long").alias("bars"), F.array_max("path.high").alias("top"), F.array_min("path.low").alias("bottom"))


@query(_pos(f"""SELECT symbol, d, CASE WHEN n = 0 THEN 'no_data' WHEN js IS NULL AND jt IS NULL THEN 'open' WHEN jt IS NULL OR js <= jt THEN 'stop' ELSE 'target' END AS outcome FROM
  (SELECT symbol, d, count(j) AS n, min(CASE WHEN c_ <= stop THEN j END) AS js, min(CASE WHEN h_ >= target THEN j END) AS jt FROM fw GROUP BY symbol, d)""", FATE))
def classify_close_basis(spark, sf_dir):
    e = enriched(spark, sf_dir)
    return outcomes.resolve(positions(spark, sf_dir, e), e, 40, close_basis=True).select("symbol", "d", "outcome")


@query(_pos("SELECT symbol, d, mfe, mae, success5 FROM fate WHERE r IS NOT NULL", FATE))
def excursions(spark, sf_dir):
    return fates(spark, sf_dir).filter("r is not null").select("symbol", "d", "mfe", "mae", "success5")


@query(_pos(f"SELECT {_SUMMARY}, {_MEANS} FROM fate", FATE))
def summarise_outcomes(spark, sf_dir):
    return fates(spark, sf_dir).agg(*outcomes.summary())


@query(_pos(f"SELECT pattern, {_STATS} FROM fate GROUP BY pattern", FATE))
def summary_stats(spark, sf_dir):
    return outcomes.described(fates(spark, sf_dir), ("pattern",))


@query(_pos(f"""SELECT kind, slice, {_STATS} FROM (SELECT f.*, k.kind, CASE k.kind WHEN 'overall' THEN 'all' WHEN 'pattern' THEN pattern WHEN 'regime' THEN regime
  ELSE CASE WHEN score <= 69 THEN '60-69' WHEN score <= 79 THEN '70-79' WHEN score <= 89 THEN '80-89' ELSE '90-100' END END AS slice FROM fate f, (VALUES ('overall'), ('pattern'), ('score'), ('regime')) k(kind)) WHERE slice IS NOT NULL GROUP BY kind, slice""", FATE))
def breakdown_grouping_sets(spark, sf_dir):
    return outcomes.breakdown(fates(spark, sf_dir))


_DD = f"""SELECT pattern, {o.r("min(cum - peak)", 3)} AS max_dd FROM (SELECT pattern, cum, greatest(max(cum) OVER (PARTITION BY pattern ORDER BY scan_day, symbol), 0.0) AS peak, scan_day FROM
  (SELECT pattern, scan_day, symbol, sum(r) OVER (PARTITION BY pattern ORDER BY scan_day, symbol) AS cum FROM fate WHERE r IS NOT NULL)) GROUP BY pattern"""


@query(_pos(_DD, FATE))
def max_drawdown(spark, sf_dir):
    return outcomes.drawdown(fates(spark, sf_dir), ("pattern",), "scan_day", ("symbol",))


@query(_pos(f"SELECT symbol, scan_day, pattern, {o.r('sum(r) OVER (PARTITION BY pattern ORDER BY scan_day, symbol)', 2)} AS curve FROM fate WHERE r IS NOT NULL", FATE))
def cumulative_r_curve(spark, sf_dir):
    """The running sum of R of each pattern."""
    f = outcomes.running(fates(spark, sf_dir).filter("r is not null"), ("pattern",), "scan_day", ("symbol",))
    return f.select("symbol", "scan_day", "pattern", r(F.col("cum"), 2).alias("curve"))


@query(_pos("""SELECT w.label AS label, count(*) AS n, count(*) FILTER (WHERE outcome = 'target') AS target FROM fate, (VALUES ('all sessions'), ('before 1999-01-01'), ('from 1999-01-01')) w(label)
  WHERE label = 'all sessions' OR (label LIKE 'before%') = (scan_day < DATE '1999-01-01') GROUP BY 1""", FATE))
def split_windows(spark, sf_dir):
    side = F.when(F.col("scan_day") < F.lit("1999-01-01").cast("date"), "before 1999-01-01").otherwise("from 1999-01-01")
    f = fates(spark, sf_dir).withColumn("label", F.explode(F.array(F.lit("all sessions"), side)))
    return f.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "target").alias("target"))


_GRID = f"""
v AS (SELECT f.symbol, f.d, f.pattern, f.fill, ex_.extra, ba.basis, mo.mode, stop - extra*atr AS vs, CASE WHEN target IS NULL THEN NULL WHEN mode = 'half' THEN fill + 0.5*(target - fill)
  WHEN mode = 'breakout' AND pattern = '{CUP}' THEN fill + (cup_trigger - cup_bottom) ELSE target END AS vt FROM fate f, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) ex_(extra), (VALUES ('intraday'), ('close')) ba(basis), (VALUES ('full'), ('half'), ('breakout')) mo(mode) WHERE r IS NOT NULL),
vw AS (SELECT v.*, x.idx AS j, x.close AS c_, CASE WHEN (CASE WHEN basis = 'close' THEN x.close ELSE x.low END) <= vs THEN 0 WHEN x.high >= vt THEN 1 END AS kind, x.open AS o_ FROM v JOIN bars x ON x.symbol = v.symbol AND x.idx > d AND x.idx <= d + 40),
vh AS (SELECT symbol, d, extra, basis, mode, min(CASE WHEN kind IS NOT NULL THEN j END) AS jh, max_by(c_, j) AS lc, any_value(fill) AS fill, any_value(vs) AS vs, any_value(vt) AS vt FROM vw GROUP BY 1, 2, 3, 4, 5),
vo AS (SELECT vh.*, CASE WHEN jh IS NULL THEN 'open' WHEN kind = 0 THEN 'stop' ELSE 'target' END AS outcome, CASE WHEN jh IS NULL THEN lc WHEN kind = 1 THEN greatest(o_, vh.vt) WHEN vh.basis = 'close' THEN c_ ELSE least(o_, vh.vs) END AS x
  FROM vh LEFT JOIN vw ON vw.symbol = vh.symbol AND vw.d = vh.d AND vw.extra = vh.extra AND vw.basis = vh.basis AND vw.mode = vh.mode AND vw.j = jh),
gr AS (SELECT *, CASE WHEN fill > vs THEN (x - fill)/(fill - vs) END AS r FROM vo)"""


@query(_pos(f"SELECT extra, basis, mode, {_SUMMARY}, {_MEANS} FROM gr GROUP BY extra, basis, mode", FATE, _GRID))
def grid_rescore(spark, sf_dir):
    return outcomes.grid(fates(spark, sf_dir), src.bars(spark, sf_dir))


_HOR = f"""
hz AS (SELECT f.symbol, f.d, f.pattern, f.fill, f.stop, f.target, f.atr, h.horizon FROM fate f, (VALUES (5), (10), (20), (40), (60)) h(horizon) WHERE r IS NOT NULL),
hw AS (SELECT z.*, x.idx AS j, x.high AS h_, x.low AS l_ FROM hz z JOIN bars x ON x.symbol = z.symbol AND x.idx > d AND x.idx <= d + horizon),
ho AS (SELECT symbol, d, pattern, horizon, any_value(fill) AS fill, any_value(atr) AS atr, max(h_) AS hi, min(l_) AS lo, min(CASE WHEN l_ <= stop THEN j END) AS js, min(CASE WHEN h_ >= target THEN j END) AS jt FROM hw GROUP BY 1, 2, 3, 4),
hs AS (SELECT *, CASE WHEN js IS NULL AND jt IS NULL THEN 'open' WHEN jt IS NULL OR js <= jt THEN 'stop' ELSE 'target' END AS outcome FROM ho),
ha AS (SELECT 'all' AS slice, * FROM hs UNION ALL SELECT pattern, * FROM hs)"""


_HORIZONS = f"""slice, horizon, count(*) AS n, {o.r('quantile_cont(hi/fill - 1, 0.5)', 4)} AS median_mfe, {o.r('quantile_cont(lo/fill - 1, 0.5)', 4)} AS median_mae, {o.r('quantile_cont((hi - fill)/atr, 0.5)', 2)} AS median_mfe_atr,
  {o.r('quantile_cont((lo - fill)/atr, 0.5)', 2)} AS median_mae_atr, {", ".join(o.r(f"count(*) FILTER (WHERE outcome = '{x}')/CAST(count(*) AS DOUBLE)", 3) + f" AS {x}" for x in ("target", "stop", "open"))}"""


@query(_pos(f"SELECT {_HORIZONS} FROM ha GROUP BY slice, horizon", FATE, _HOR))
def horizon_table(spark, sf_dir):
    return outcomes.horizon_table(fates(spark, sf_dir), src.bars(spark, sf_dir))


def bootstrap_sql(table: str, by: str, name: str, order: str = "scan_day, symbol") -> str:
    """``name`` (by, ci_low, ci_high, dd_p95, blocks): the month bootstrap of a table with scan_day and r."""
    order = "scan_day" if table == "pr" else order
    low, high, deep = (f"CASE WHEN blocks >= 2 AND trades >= 5 THEN {o.r(f'quantile_cont({c}, {p})', 3)} END" for c, p in (("mean", 0.025), ("mean", 0.975), ("dd", 0.05)))
    return f"""{name}_t AS (SELECT {by}, strftime(scan_day, '%Y-%m') AS month, r, sum(r) OVER (PARTITION BY {by}, strftime(scan_day, '%Y-%m') ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY {by}, strftime(scan_day, '%Y-%m') ORDER BY {order}) AS q FROM {table} WHERE r IS NOT NULL),
{name}_u AS (SELECT *, max(c) OVER (PARTITION BY {by}, month ORDER BY q) AS p FROM {name}_t),
{name}_m AS (SELECT {by}, month, sum(r) AS s, count(*) AS k, max(c) AS top, min(c) AS low, min(c - p) AS fall FROM {name}_u GROUP BY 1, 2),
{name}_b AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY month) - 1 AS at, count(*) OVER (PARTITION BY {by}) AS blocks, sum(k) OVER (PARTITION BY {by}) AS trades FROM {name}_m),
{name}_d AS (SELECT m.{by}, g.rep, p.pos, CAST('0x' || substr(md5('0-' || g.rep || '-' || p.pos), 1, 8) AS BIGINT) % m.blocks AS at FROM (SELECT DISTINCT {by}, blocks FROM {name}_b) m, generate_series(0, 1999) g(rep), generate_series(0, 400) p(pos) WHERE p.pos < m.blocks),
{name}_w AS (SELECT d.rep, d.pos, b.*, coalesce(sum(s) OVER w, 0) AS before FROM {name}_d d JOIN {name}_b b ON b.{by} = d.{by} AND b.at = d.at WINDOW w AS (PARTITION BY d.{by}, d.rep ORDER BY d.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_x AS (SELECT *, greatest(coalesce(max(before + top) OVER (PARTITION BY {by}, rep ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS peak FROM {name}_w),
{name}_r AS (SELECT {by}, blocks, trades, rep, sum(s)/sum(k) AS mean, min(least(before + low - peak, fall)) AS dd FROM {name}_x GROUP BY 1, 2, 3, 4),
{name} AS (SELECT {by}, {low} AS ci_low, {high} AS ci_high, {deep} AS dd_p95, blocks FROM {name}_r GROUP BY {by}, blocks, trades)"""


@query(_pos("SELECT * FROM bt", FATE, bootstrap_sql("fate", "pattern", "bt")))
def month_block_bootstrap(spark, sf_dir):
    return outcomes.month_bootstrap(fates(spark, sf_dir), ("pattern",))


#: Right-inclusive edges of features that the positions have.
EDGES = {"risk_pct": (float("-inf"), 4.0, 8.0, 12.0, float("inf")), "stop_atr": (float("-inf"), 1.5, 3.0, 5.0, float("inf")), "reward_risk": (float("-inf"), 1.5, 2.5, 4.0, float("inf"))}
_FEAT = f"""
ft AS (SELECT outcome, r, 'risk_pct' AS feature, (entry - stop)/entry*100 AS value FROM fate WHERE r IS NOT NULL UNION ALL SELECT outcome, r, 'stop_atr', (entry - stop)/atr FROM fate WHERE r IS NOT NULL
  UNION ALL SELECT outcome, r, 'reward_risk', {o.r('(target - entry)/(entry - stop)', 2)} FROM fate WHERE r IS NOT NULL),
fm AS (SELECT *, count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY feature) AS missing, CASE feature WHEN 'risk_pct' THEN (value > 4)::INT + (value > 8)::INT + (value > 12)::INT WHEN 'stop_atr' THEN (value > 1.5)::INT + (value > 3)::INT + (value > 5)::INT
  ELSE (value > 1.5)::INT + (value > 2.5)::INT + (value > 4)::INT END AS bucket FROM ft)"""


@query(_pos(f"SELECT feature, bucket, missing, {_SUMMARY}, {_MEANS} FROM fm WHERE value IS NOT NULL GROUP BY feature, bucket, missing", FATE, _FEAT))
def feature_buckets(spark, sf_dir):
    f = fates(spark, sf_dir)
    f = f.withColumn("risk_pct", (F.col("entry") - F.col("stop")) / F.col("entry") * 100).withColumn("stop_atr", (F.col("entry") - F.col("stop")) / F.col("atr")).withColumn("reward_risk", r((F.col("target") - F.col("entry")) / (F.col("entry") - F.col("stop")), 2))
    return outcomes.feature_buckets(f, EDGES)


@query(_pos("SELECT symbol, d, CASE WHEN r > 0 THEN 'win' WHEN r < 0 THEN 'loss' WHEN r = 0 THEN 'flat' WHEN outcome = 'no_data' THEN 'pending' ELSE 'none' END AS label FROM fate", FATE))
def result_labels_by_r(spark, sf_dir):
    label = F.when(F.col("r") > 0, "win").when(F.col("r") < 0, "loss").when(F.col("r") == 0, "flat").when(F.col("outcome") == "no_data", "pending").otherwise("none")
    return fates(spark, sf_dir).select("symbol", "d", label.alias("label"))
