"""Queries over lifecycle, replay, report tables and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from wickwork.functions.columns import r
from wickwork.functions.rules import CUP, DOUBLE, IHS, LEGACY, WOLFE, Fixed, profile
from wickwork.operators import detectors as det
from wickwork.operators import lifecycle, marts, outcomes, replay
from wickwork.plans import oracle as o
from wickwork.plans.registry import query
from wickwork.plans.results import bootstrap_sql, _GRID, _HOR, _HORIZONS, _MEANS, _STATS, _SUMMARY, E, FATE, MARKET, POS, market_table, positions
from wickwork.plans.scans import _FG, enriched
from wickwork.functions import indicators as ind
from wickwork.operators import market
from wickwork.sources import bars as src
from wickwork.sources import runs as store
from wickwork.sources.store import shared_dir, written
from wickwork.streaming import bars as streaming
from wickwork.streaming import listings

TUNED = profile("tuned")
#: Bars from one run to the next: every session has its run.
STEP = 1
LOG = o.scan_all("tuned") + ", slog AS (SELECT *, CAST(d AS BIGINT) AS run FROM allsig)"


def scanned(spark, sf_dir, rules=TUNED, e=None):
    """All four patterns as of every bar."""
    return det.scan(enriched(spark, sf_dir, rules) if e is None else e, rules)


def signal_log(spark, sf_dir, e=None):
    """The signals of every session's run, as a table."""
    return written(scanned(spark, sf_dir, e=e).withColumn("run", F.col("d").cast("long")))


def _l(body, *more):
    return o.with_(o.BARS, LOG, *more) + body


def _case(name, values):
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_LIMIT = _case("pattern", {CUP: 6, IHS: 6, WOLFE: 5, DOUBLE: 6})
_AGE = _case("pattern", {CUP: 3, IHS: 8, WOLFE: 8, DOUBLE: 8})


@query(_l("SELECT run, symbol, pattern, status, entry, stop, score FROM slog WHERE status = 'CONFIRMED'"))
def signal_log_scan(spark, sf_dir):
    return signal_log(spark, sf_dir).filter("status = 'CONFIRMED'").select("run", "symbol", "pattern", "status", "entry", "stop", "score")


@query(_l("SELECT symbol, run, pattern, status, entry, stop FROM slog WHERE run = (SELECT max(run) FROM slog)"))
def prev_run_latest_partition(spark, sf_dir):
    """The latest run's partition, by a run's number."""
    s = signal_log(spark, sf_dir)
    return s.join(s.agg(F.max("run").alias("run")), "run", "left_semi").select("symbol", "run", "pattern", "status", "entry", "stop")


_LISTED = f"""
l1 AS (SELECT *, CASE WHEN lag(run) OVER (PARTITION BY symbol, pattern, stop ORDER BY run) = run - 1 THEN 0 ELSE 1 END AS fresh FROM slog),
l2 AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, pattern, stop ORDER BY run) AS island FROM l1),
l3 AS (SELECT *, min(CASE WHEN status = 'CONFIRMED' THEN d END) OVER w AS first_d, min(CASE WHEN status = 'CONFIRMED' THEN day END) OVER w AS first_listed FROM l2 WINDOW w AS (PARTITION BY symbol, pattern, stop, island ORDER BY run)),
l4 AS (SELECT *, CAST(d - first_d + 1 AS INT) AS listed_day FROM l3),
l5 AS (SELECT *, min(CASE WHEN status = 'CONFIRMED' AND listed_day > {_LIMIT} THEN run END) OVER (PARTITION BY symbol, pattern, stop, island ORDER BY run) AS ra FROM l4),
listed AS (SELECT *, CASE WHEN ra IS NULL THEN 'kept' WHEN ra = run THEN 'retired' ELSE 'silent' END AS state FROM l5)"""


@query(_l("SELECT symbol, run, pattern, stop, status, first_listed, listed_day, state FROM listed", _LISTED))
def carry_listing(spark, sf_dir):
    return lifecycle.listings(signal_log(spark, sf_dir), TUNED).select("symbol", "run", "pattern", "stop", "status", "first_listed", "listed_day", "state")


@query(_l("SELECT symbol, pattern, stop, min(first_listed) AS first_listed FROM listed GROUP BY 1, 2, 3", _LISTED))
def carry_first_listed(spark, sf_dir):
    return lifecycle.listings(signal_log(spark, sf_dir), TUNED).groupBy("symbol", "pattern", "stop").agg(F.min("first_listed").alias("first_listed"))


@query(_l("SELECT DISTINCT x.symbol, x.pattern, x.stop FROM listed x JOIN slog y ON x.symbol = y.symbol AND x.pattern = y.pattern AND x.stop = y.stop AND y.run = x.run + 1 WHERE x.state = 'retired'", _LISTED))
def retired_semi_join(spark, sf_dir):
    """Retired structures that the next run still produces stay in memory."""
    s = signal_log(spark, sf_dir)
    still = s.select("symbol", "pattern", "stop", (F.col("run") - 1).alias("run"))
    return lifecycle.listings(s, TUNED).filter("state = 'retired'").join(still, ["symbol", "pattern", "stop", "run"], "left_semi").select("symbol", "pattern", "stop").distinct()


_GONE = "gone AS (SELECT * FROM slog x WHERE NOT EXISTS (SELECT 1 FROM slog y WHERE y.symbol = x.symbol AND y.pattern = x.pattern AND y.run = x.run + 1))"
_CLOSE = f"""{_GONE},
cw AS (SELECT g.*, b.idx AS j, b.day AS jday, b.high AS h_, b.close AS c_ FROM gone g LEFT JOIN bars b ON b.symbol = g.symbol AND b.idx > g.d AND b.idx <= g.d + {STEP}),
cx AS (SELECT symbol, run, pattern, status, count(j) AS n, min(CASE WHEN c_ <= stop THEN j END) AS jf, min(CASE WHEN h_ >= target THEN j END) AS jt, max_by(c_, j) AS lastc FROM cw GROUP BY 1, 2, 3, 4),
closed AS (SELECT g.*, n, CASE WHEN n = 0 THEN 'DROPPED' WHEN jf IS NOT NULL AND (jt IS NULL OR jf <= jt) THEN 'FAILED' WHEN jt IS NOT NULL THEN 'TARGET_REACHED' WHEN g.status = 'CONFIRMED' AND bars_since_break + n > {_AGE.replace('CASE pattern', 'CASE g.pattern')} THEN 'EXPIRED'
  WHEN lastc < entry*0.95 THEN 'FADED' ELSE 'DROPPED' END AS outcome FROM gone g JOIN cx ON cx.symbol = g.symbol AND cx.run = g.run AND cx.pattern = g.pattern AND cx.status = g.status)"""


@query(_l("SELECT symbol, run, pattern, status, stop FROM gone", _GONE))
def closed_anti_join(spark, sf_dir):
    return lifecycle.vanished(signal_log(spark, sf_dir)).select("symbol", "run", "pattern", "status", "stop")


def _closed(spark, sf_dir):
    e = enriched(spark, sf_dir, TUNED)
    return lifecycle.close_out(signal_log(spark, sf_dir, e), e, TUNED, STEP)


@query(_l("SELECT symbol, run, pattern, status, stop, outcome, n AS bars FROM closed", _CLOSE))
def close_out(spark, sf_dir):
    return _closed(spark, sf_dir).select("symbol", "run", "pattern", "status", "stop", "outcome", "bars")


_REASON = f"CASE WHEN reward_risk < 1.0 THEN 'reward below the minimum' WHEN status = 'WATCHLIST' AND d + {STEP} - last > 60 THEN 'no breakout in time' ELSE 'pattern no longer qualifies' END"


@query(_l(f"SELECT symbol, run, pattern, status, {_REASON} AS reason FROM closed WHERE outcome = 'DROPPED'", _CLOSE))
def drop_reason(spark, sf_dir):
    return lifecycle.drop_reason(_closed(spark, sf_dir).filter("outcome = 'DROPPED'"), TUNED, STEP).select("symbol", "run", "pattern", "status", "reason")


_ORDER = _case("outcome", {k: i for i, k in enumerate(marts.CLOSED_ORDER)})


@query(_l(f"SELECT symbol, run, pattern, status, outcome, row_number() OVER (PARTITION BY run ORDER BY {_ORDER}, symbol, pattern, status) AS place FROM closed", _CLOSE))
def closed_ranked(spark, sf_dir):
    order = F.array_position(F.array(*map(F.lit, marts.CLOSED_ORDER)), F.col("outcome"))
    return _closed(spark, sf_dir).select("symbol", "run", "pattern", "status", "outcome", F.row_number().over(Window.partitionBy("run").orderBy(order, "symbol", "pattern", "status")).alias("place"))


@query(_l("SELECT symbol, run, pattern, outcome FROM closed UNION ALL SELECT symbol, run, pattern, 'RETIRED' AS outcome FROM listed WHERE state = 'retired'", _LISTED, _CLOSE))
def closed_all(spark, sf_dir):
    e = enriched(spark, sf_dir, TUNED)
    s = signal_log(spark, sf_dir, e)
    c = lifecycle.close_out(s, e, TUNED, STEP).select("symbol", "run", "pattern", "outcome")
    return c.unionByName(lifecycle.listings(s, TUNED).filter("state = 'retired'").select("symbol", "run", "pattern", F.lit("RETIRED").alias("outcome")))


@query(_l("SELECT symbol, pattern, stop, min_by(entry, run) AS entry, min(day) AS first_seen, count(DISTINCT day) AS listed_days, max(day) AS last_listed FROM slog WHERE status = 'CONFIRMED' GROUP BY 1, 2, 3"))
def signal_history(spark, sf_dir):
    return lifecycle.history(signal_log(spark, sf_dir)).select("symbol", "pattern", "stop", "entry", "first_seen", F.col("listed_days").cast("long").alias("listed_days"), "last_listed")


@query(o.with_(o.BARS, E, POS) + f"SELECT symbol, d, pattern, CASE WHEN pattern = '{CUP}' THEN 'WATCHLIST' ELSE 'CONFIRMED' END AS status, pattern = '{CUP}' AS watch_only FROM pos")
def demote_watch_only(spark, sf_dir):
    p = positions(spark, sf_dir).withColumn("status", F.lit("CONFIRMED"))
    return lifecycle.demote(p, profile()).select("symbol", "d", "pattern", "status", "watch_only")


# The list as a stream, and the store of runs -----------------------------------------------------------------------------

#: Days of bars that the stream is given between two starts.
_DAYS = 700


@query(_l("SELECT symbol, run, pattern, stop, status, state AS event, CAST(first_listed AS VARCHAR) AS first_listed, listed_day, NULL AS outcome FROM listed UNION ALL SELECT symbol, run, pattern, stop, status, 'closed', NULL, NULL, outcome FROM closed WHERE n > 0", _LISTED, _CLOSE))
def follow_stream(spark, sf_dir):
    """The whole log fed to the keyed stream in stretches of days; for each it starts again from its checkpoint."""
    e = enriched(spark, sf_dir, TUNED)
    folder = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    rows = written(listings.runs(signal_log(spark, sf_dir, e), e).withColumn("part", F.floor(F.datediff("day", F.lit("1990-01-01").cast("date")) / _DAYS)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", listings.PROVIDER)
    stream = None
    for part in sorted(r.part for r in rows.select("part").distinct().collect()):
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/runs")
        stream = listings.follow(spark.readStream.schema(listings.RUN).parquet(f"{folder}/runs"), TUNED)
        q = stream.writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    if stream is None:
        return spark.createDataFrame([], listings.EVENT).drop("bars")
    return spark.read.schema(listings.EVENT).parquet(f"{folder}/events").filter("bars is null or bars > 0").drop("bars")


@query(_l("SELECT CAST(symbol AS VARCHAR) AS symbol, run, pattern, status, entry, stop, target, score, 'tuned' AS profile FROM slog WHERE run = (SELECT max(run) FROM slog WHERE run < 200)"))
def run_store_previous(spark, sf_dir):
    """The log as a store of documents by run; the newest run before run 200, read back from its folder alone."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.write(store.documents(signal_log(spark, sf_dir), "tuned"), path)
    return store.signals(store.latest(spark, path, 200)).select("symbol", "run", "pattern", "status", "entry", "stop", "target", "score", "profile")


# Trade levels on the positions --------------------------------------------------------------------------------------------

def _p(body, *more):
    return o.with_(o.BARS, E, POS, *more) + body


@query(_p(f"SELECT symbol, d, entry, stop, {o.r('(entry - stop)/entry*100', 2)} AS risk_pct FROM pos WHERE stop < entry AND (entry - stop)/entry*100 <= 12"))
def trade_levels(spark, sf_dir):
    p = positions(spark, sf_dir).withColumn("risk", (F.col("entry") - F.col("stop")) / F.col("entry") * 100)
    return p.filter("stop < entry and risk <= 12").select("symbol", "d", "entry", "stop", r(F.col("risk"), 2).alias("risk_pct"))


@query(_p(f"SELECT symbol, d, CASE WHEN target IS NOT NULL AND entry > stop THEN {o.r('(target - entry)/(entry - stop)', 2)} END AS reward_risk FROM pos"))
def reward_risk(spark, sf_dir):
    return positions(spark, sf_dir).select("symbol", "d", F.when(F.col("target").isNotNull() & (F.col("entry") > F.col("stop")), r((F.col("target") - F.col("entry")) / (F.col("entry") - F.col("stop")), 2)).alias("reward_risk"))


@query(_p(f"SELECT symbol, d, {o.r('least(entry*1.05, stop + 1.5*(entry - stop))', 2)} AS max_buy FROM pos"))
def max_buy(spark, sf_dir):
    return positions(spark, sf_dir).select("symbol", "d", r(F.least(F.col("entry") * 1.05, F.col("stop") + 1.5 * (F.col("entry") - F.col("stop"))), 2).alias("max_buy"))


@query(o.with_(o.BARS, *o.detector(DOUBLE, "spec", max_wait_bars=60)) + "SELECT symbol, d, cand FROM sig")
def watch_patience(spark, sf_dir):
    """Watched rows whose last anchor is too old go; confirmed ones stay."""
    rules = profile("spec", max_wait_bars=60)
    return det.scan(enriched(spark, sf_dir, rules), rules, (DOUBLE,)).select("symbol", "d", "cand")


@query(o.with_(o.BARS, *o.detector(DOUBLE, "spec")) + "SELECT score, status, count(*) AS n FROM sig GROUP BY 1, 2")
def quality_score(spark, sf_dir):
    return det.scan(enriched(spark, sf_dir), profile(), (DOUBLE,)).groupBy("score", "status").agg(F.count("*").alias("n"))


@query(o.with_(o.BARS, *o.detector(IHS, "tuned")) + "SELECT symbol, d, status, cand, score FROM sig")
def dedupe_best(spark, sf_dir):
    e = enriched(spark, sf_dir, TUNED)
    return det.best(det.states(det.candidates(e, TUNED, IHS), e, Fixed(TUNED, IHS), IHS)).select("symbol", "d", "status", "cand", "score")


# Replay -------------------------------------------------------------------------------------------------------------------

def _replayed_sql(where="true"):
    return f""",
rp AS (SELECT s.*, n.no AS sno FROM allsig s JOIN (SELECT day, row_number() OVER (ORDER BY day) - 1 AS no FROM (SELECT DISTINCT day FROM bars)) n USING (day) WHERE status = 'CONFIRMED' AND {where.replace('x.', 's.')}),
rl AS (SELECT *, min(day) OVER (PARTITION BY symbol, pattern, stop) AS first_day, CAST(sno - min(sno) OVER (PARTITION BY symbol, pattern, stop) + 1 AS INT) AS listed_day FROM rp)"""


_REPLAYED = _replayed_sql()


def _replay_sql(prof="tuned", extra="", where="true", **over):
    return o.scan_all(prof, **over) + extra + _replayed_sql(where)


def _fate_of(table: str) -> str:
    """The accounting of FATE over another table of signals."""
    return FATE.replace("FROM pos p", f"FROM {table} p")


_ALL = "SELECT symbol, day, pattern, stop, entry, score, outcome, fill2 AS fill, r4 AS r FROM (SELECT *, " + o.r("fill", 2) + " AS fill2, " + o.r("r", 4) + " AS r4 FROM fate)"
_FIRST = "rf AS (SELECT * FROM rl WHERE day = first_day)"


def replayed(spark, sf_dir, rules=TUNED, members=False):
    e = enriched(spark, sf_dir, rules)
    rows = replay.listed(scanned(spark, sf_dir, rules, e), replay.sessions(e), src.membership_snapshots(spark, sf_dir) if members else None)
    return rows, e


@query(o.with_(o.BARS, _replay_sql(), _FIRST, _fate_of("rf")) + _ALL)
def walk_forward_first_seen(spark, sf_dir):
    rows, e = replayed(spark, sf_dir)
    f = outcomes.scored(replay.first_seen(rows), e)
    return f.select("symbol", "day", "pattern", "stop", "entry", "score", "outcome", r(F.col("fill"), 2).alias("fill"), r(F.col("r"), 4).alias("r"))


@query(o.with_(o.BARS, _replay_sql(), "rr AS (SELECT * FROM rl WHERE day > first_day)", _fate_of("rr")) + "SELECT symbol, day, pattern, stop, first_day, listed_day, outcome FROM fate")
def walk_forward_repeats(spark, sf_dir):
    rows, e = replayed(spark, sf_dir)
    return outcomes.scored(replay.repeats(rows), e).select("symbol", "day", "pattern", "stop", "first_day", "listed_day", "outcome")


_MEMBER = "EXISTS (SELECT 1 FROM snapshots m WHERE m.symbol = x.symbol AND m.snapshot_date = coalesce((SELECT max(snapshot_date) FROM snapshots q WHERE q.snapshot_date <= x.day), (SELECT min(snapshot_date) FROM snapshots)))"


@query(o.with_(o.BARS, o.SNAPSHOTS, _replay_sql(where=_MEMBER)) + "SELECT symbol, day, pattern, stop FROM rl WHERE day = first_day")
def walk_forward_members(spark, sf_dir):
    rows, _ = replayed(spark, sf_dir, members=True)
    return replay.first_seen(rows).select("symbol", "day", "pattern", "stop")


def _windowed_sql(bars):
    parts, names = [o.enriched(TUNED)], []
    for i, (p, (candidates, _)) in enumerate(o.CANDIDATES.items()):
        text = candidates(TUNED, True) if p == IHS else candidates(TUNED)
        parts += [text.replace(f"\n{o._lows()},", "") if any(o._lows() in x for x in parts) else text, o.signals(TUNED, p, f"s{i}_", bars=bars)]
        names.append(f"SELECT * FROM s{i}_")
    return ",".join(parts) + ", allsig AS (" + " UNION ALL ".join(names) + ")"


@query(o.with_(o.BARS, _windowed_sql(250)) + "SELECT symbol, pattern, stop, min(d) AS d, count(*) AS reports FROM allsig WHERE status = 'CONFIRMED' GROUP BY 1, 2, 3")
def walk_forward_bars_window(spark, sf_dir):
    """First reports of all four patterns, and how often each came, when every scan sees the last 250 bars."""
    e = enriched(spark, sf_dir, TUNED)
    s = det.scan(e, TUNED, bars=250).filter("status = 'CONFIRMED'")
    return s.groupBy("symbol", "pattern", "stop").agg(F.min("d").alias("d"), F.count("*").alias("reports"))


@query(o.with_(o.BARS) + "SELECT day, row_number() OVER (ORDER BY day) - 1 AS no FROM (SELECT DISTINCT day FROM bars WHERE day <= DATE '2000-12-31' ORDER BY day DESC LIMIT 63)")
def scan_sessions(spark, sf_dir):
    return replay.sessions(src.bars(spark, sf_dir), 63, "2000-12-31")


@query(o.with_(o.BARS, _replay_sql(), "rr AS (SELECT * FROM rl)", _fate_of("rr"), "a AS (SELECT symbol, pattern, stop, first_day, r AS r1 FROM fate WHERE r IS NOT NULL AND day = first_day)")
       + f"SELECT f.symbol, f.pattern, f.stop, f.listed_day, {o.r('r1', 4)} AS r1, {o.r('r - r1', 4)} AS diff FROM fate f JOIN a USING (symbol, pattern, stop, first_day) WHERE r IS NOT NULL AND day > first_day")
def late_entry_pairs(spark, sf_dir):
    rows, e = replayed(spark, sf_dir)
    s = outcomes.scored(rows, e)
    return replay.pairs(replay.first_seen(s), replay.repeats(s)).select("symbol", "pattern", "stop", "listed_day", r(F.col("r1"), 4).alias("r1"), r(F.col("diff"), 4).alias("diff"))


_LATE = f"""
a1 AS (SELECT symbol, pattern, stop, first_day, r AS r1 FROM fate WHERE r IS NOT NULL AND day = first_day),
pr AS (SELECT f.listed_day, a1.first_day AS scan_day, r1, f.r AS rn, f.r - r1 AS r FROM fate f JOIN a1 ON a1.symbol = f.symbol AND a1.pattern = f.pattern AND a1.stop = f.stop AND a1.first_day = f.first_day WHERE f.r IS NOT NULL AND day > f.first_day),
pm AS (SELECT listed_day, count(*) AS pairs, {o.r('avg(r1)', 3)} AS pair_day1_mean_r, {o.r('avg(rn)', 3)} AS pair_mean_r, {o.r('avg(r)', 3)} AS diff_mean_r FROM pr GROUP BY listed_day),
ls AS (SELECT listed_day, {_SUMMARY}, {o.r('avg(r)', 3)} AS mean_r, {o.r('sum(r)', 2)} AS total_r FROM fate GROUP BY listed_day),
{bootstrap_sql("pr", "listed_day", "bt")}"""


@query(o.with_(o.BARS, _replay_sql(), "rr AS (SELECT * FROM rl)", _fate_of("rr"), _LATE) + "SELECT ls.*, pairs, pair_day1_mean_r, pair_mean_r, diff_mean_r, ci_low AS diff_ci_low, ci_high AS diff_ci_high FROM ls LEFT JOIN pm USING (listed_day) LEFT JOIN bt USING (listed_day)")
def late_entry_table(spark, sf_dir):
    """Outcomes by day on the list, and each later listing against its own first report with a month-block interval."""
    rows, e = replayed(spark, sf_dir)
    return replay.late_entry(written(outcomes.scored(rows, e)))


def _under_sql(variants, base=None):
    """``every``: the scored first reports under each of (label, profile, overrides, patterns), each from a scan of its own;
    patterns that a label's rules do not touch are taken from the label ``base``."""
    def one(i, label, prof, over, chosen):
        q = profile(prof, **over)
        panel = panels.setdefault(o.enriched(q), f"panel{len(panels)}")
        scans = [f"e AS (SELECT * FROM {panel})"]
        for k, p in enumerate(chosen):
            text = o.CANDIDATES[p][0](q)
            scans += [text.replace(f"\n{o._lows()},", "") if any(o._lows() in x for x in scans) else text, o.signals(q, p, f"s{k}_")]
        union = "allsig AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}_" for k in range(len(chosen))) + ")"
        return f"v{i} AS MATERIALIZED (SELECT '{label}' AS label, * FROM (WITH {', '.join(scans)}, {union}{_REPLAYED}, {_FIRST}, {_fate_of('rf')} SELECT pattern, score, outcome, r, success5, mfe, mae FROM fate))"

    panels: dict[str, str] = {}
    tables = [one(i, *v) for i, v in enumerate(variants)]
    tables = [f"{name} AS MATERIALIZED (WITH {text} SELECT * FROM e)" for text, name in panels.items()] + tables
    rows = [f"SELECT * FROM v{i}" for i in range(len(variants))]
    rows += [f"SELECT '{label}' AS label, * EXCLUDE (label) FROM v{base} WHERE pattern NOT IN ({', '.join(repr(p) for p in chosen)})" for label, _, _, chosen in variants if base is not None and len(chosen) < 4]
    return ",".join([o.BARS.replace("bars AS (", "bars AS MATERIALIZED ("), *tables, "every AS (" + " UNION ALL ".join(rows) + ")"])


_FOUR = (CUP, IHS, WOLFE, DOUBLE)


def _touched(key):
    """The patterns that a rule's name says it is for."""
    return next((ps for prefix, ps in (("cup_", (CUP,)), ("handle_", (CUP,)), ("ihs_", (IHS,)), ("ww_", (WOLFE,)), ("db_", (DOUBLE,)), ("veto_", (IHS, WOLFE, DOUBLE))) if key.startswith(prefix)), _FOUR)


@query("WITH " + _under_sql([(p, p, {}, _FOUR) for p in ("tuned", "spec", "legacy")]) + f""" SELECT label, kind, slice, {_STATS} FROM (SELECT every.*, k.kind, CASE k.kind WHEN 'overall' THEN 'all' WHEN 'pattern' THEN pattern
  ELSE CASE WHEN score <= 69 THEN '60-69' WHEN score <= 79 THEN '70-79' WHEN score <= 89 THEN '80-89' ELSE '90-100' END END AS slice FROM every, (VALUES ('overall'), ('pattern'), ('score')) k(kind)) GROUP BY label, kind, slice""")
def profile_compare(spark, sf_dir):
    """What became of the first reports under each rule profile, from one replay."""
    rows = replay.under(src.bars(spark, sf_dir), {p: profile(p) for p in ("tuned", "spec", "legacy")})
    return outcomes.breakdown(rows.withColumn("regime", F.lit(None).cast("string")), ("label",))


_ALL_RULES = "spec (all rules)"
_VALUES_OF = {_ALL_RULES: "-"} | {k: str(v) for k, v in LEGACY.items()}


@query("WITH " + _under_sql([(_ALL_RULES, "spec", {}, _FOUR), *((k, "spec", {k: v}, _touched(k)) for k, v in LEGACY.items())], 0) + f""",
st AS (SELECT label AS rule, {_STATS} FROM every GROUP BY label),
kv AS (SELECT * FROM (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in _VALUES_OF.items())}) v(rule, value)),
dl AS (SELECT rule, value, coalesce(signals, 0) AS signals, coalesce(signals, 0) - coalesce((SELECT signals FROM st WHERE rule = '{_ALL_RULES}'), 0) AS delta, st.* EXCLUDE (rule, signals) FROM kv LEFT JOIN st USING (rule))
SELECT *, CAST(row_number() OVER (ORDER BY rule = '{_ALL_RULES}', abs(delta) DESC, rule) AS INT) AS place FROM dl""")
def ablation(spark, sf_dir):
    """Each rule of the legacy profile relaxed alone: signals gained or lost and what became of them, from one replay."""
    return replay.ablation(src.bars(spark, sf_dir))


_CANDS = "cands AS (" + " UNION ALL ".join(f"SELECT symbol, pattern, cand, height, last_low, target_at FROM {c}" for _, c in o.CANDIDATES.values()) + ")"
_FEATURES = f"""first_ AS (SELECT * FROM rl WHERE day = first_day),
{_CANDS},
cd AS (SELECT DISTINCT c.symbol, c.pattern, c.cand, c.last_low, CASE c.pattern WHEN '{IHS}' THEN least(x.low, c.last_low) - c.target_at WHEN '{WOLFE}' THEN x.low - c.last_low ELSE c.height END AS depth FROM cands c JOIN e x ON x.symbol = c.symbol AND x.idx = c.cand // {o.SPAN}),
hv_ AS (SELECT s.symbol, s.d, s.cand, avg(z.volume) FILTER (WHERE z.idx <= s.cand % {o.SPAN}) AS cup_v, avg(z.volume) FILTER (WHERE z.idx > s.cand % {o.SPAN}) AS handle_v, count(*) FILTER (WHERE z.idx > s.cand % {o.SPAN}) AS n,
  regr_slope(CASE WHEN z.idx > s.cand % {o.SPAN} THEN z.volume END, z.idx) AS slope FROM first_ s JOIN e z ON z.symbol = s.symbol AND z.idx >= s.cand // {o.SPAN} AND z.idx < s.d - s.bars_since_break WHERE s.pattern = '{CUP}' GROUP BY 1, 2, 3),
ft_ AS (SELECT s.symbol, s.d, s.pattern, s.stop, {o.r('e.close/e.sma200 - 1', 4)} AS close_vs_sma200, {o.r('e.sma50/e.sma200 - 1', 4)} AS sma50_vs_sma200, {o.r('e.sma200/q.sma200 - 1', 4)} AS sma200_slope, {o.r('(e.close - e.sma200)/e.atr', 3)} AS dist_sma200_atr,
  {o.r('(s.entry - s.stop)/e.atr', 3)} AS stop_atr, {o.r('(s.target - s.entry)/e.atr', 3)} AS target_atr, CAST(s.d - s.bars_since_break - s.last AS INT) AS wait_bars, {o.r('cd.depth/e.atr', 3)} AS depth_atr,
  CASE WHEN b.high > b.low THEN {o.r('(b.close - b.low)/(b.high - b.low)', 3)} END AS break_close_pos, CASE WHEN b.close > p.high THEN 1.0 ELSE 0.0 END AS break_over_prior_high, b.vz AS volume_z,
  CASE WHEN cup_v > 0 THEN {o.r('handle_v/cup_v', 3)} END AS handle_volume_ratio, CASE WHEN h.n >= 3 AND handle_v > 0 THEN {o.r('slope/handle_v', 4)} END AS handle_volume_slope,
  g.fear_greed AS fg_score, {o.r('f.rsi', 1)} AS fg_rsi, f.macd_pct AS fg_macd_pct, bb.pctb AS fg_bb_pctb, l.fear_greed AS fg_base
  FROM first_ s JOIN e ON e.symbol = s.symbol AND e.idx = s.d LEFT JOIN e q ON q.symbol = s.symbol AND q.idx = s.d - 40 JOIN e b ON b.symbol = s.symbol AND b.idx = s.d - s.bars_since_break JOIN e p ON p.symbol = s.symbol AND p.idx = b.idx - 1
  LEFT JOIN (SELECT symbol, pattern, cand, max(depth) AS depth FROM cd GROUP BY 1, 2, 3) cd ON cd.symbol = s.symbol AND cd.pattern = s.pattern AND cd.cand = s.cand LEFT JOIN hv_ h ON h.symbol = s.symbol AND h.d = s.d AND h.cand = s.cand AND s.pattern = '{CUP}'
  JOIN fgs g ON g.symbol = s.symbol AND g.idx = s.d JOIN fg f ON f.symbol = s.symbol AND f.idx = s.d JOIN bb ON bb.symbol = s.symbol AND bb.idx = s.d LEFT JOIN fgs l ON l.symbol = s.symbol AND l.idx = s.last)"""


def _featured(spark, sf_dir):
    rows, e = replayed(spark, sf_dir)
    first = written(replay.first_seen(rows))
    return replay.features(first, e, written(ind.with_fear_greed(src.bars(spark, sf_dir)).select("symbol", "idx", "fear_greed", "rsi", "macd_pct", "pctb"))), e


@query(_FG + "," + _replay_sql() + "," + _FEATURES + " SELECT * FROM ft_")
def row_features(spark, sf_dir):
    """The 18 features of first reports: at the scan bar, at the breakout bar and at the last anchor."""
    return _featured(spark, sf_dir)[0].select("symbol", "d", "pattern", "stop", *replay.FEATURES)


_VALUES = [k for k in outcomes.FEATURE_EDGES]


def _bucket_sql():
    one = lambda k: f"SELECT outcome, r, '{k}' AS feature, CAST({k} AS DOUBLE) AS value, {' + '.join(f'({k} > {x})::INT' for x in outcomes.FEATURE_EDGES[k])} AS bucket FROM fj"
    return " UNION ALL ".join(map(one, _VALUES))


_ASOF_ONE = ", ".join(f"(SELECT max_by({c}, day) FROM market m WHERE m.day <= x.day AND {c} IS NOT NULL) AS {c}" for c in ("vix", "breadth"))


@query(_FG + "," + _replay_sql() + "," + _FEATURES + "," + MARKET + ", rf AS (SELECT * FROM first_)," + _fate_of("rf") + f""",
fj AS (SELECT x.*, ft_.* EXCLUDE (symbol, d, pattern, stop), {_ASOF_ONE} FROM fate x JOIN ft_ ON ft_.symbol = x.symbol AND ft_.d = x.d AND ft_.pattern = x.pattern AND ft_.stop = x.stop WHERE r IS NOT NULL),
fl AS ({_bucket_sql()}), fm AS (SELECT *, count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY feature) AS missing FROM fl)
SELECT feature, CAST(bucket AS INT) AS bucket, missing, {_SUMMARY}, {_MEANS} FROM fm WHERE value IS NOT NULL GROUP BY feature, bucket, missing""")
def signal_feature_buckets(spark, sf_dir):
    """Outcomes of the detectors' first reports by each of 23 features."""
    f, e = _featured(spark, sf_dir)
    f = market.as_of(f, "day", market_table(spark, sf_dir, e), ("vix", "breadth"))
    return outcomes.feature_buckets(outcomes.scored(f, e), {k: (float("-inf"), *v, float("inf")) for k, v in outcomes.FEATURE_EDGES.items()})


def _first_scored(spark, sf_dir):
    """The detectors' first reports with market, levels for the grid, and what became of them."""
    rows, e = replayed(spark, sf_dir)
    f = market.as_of(written(replay.first_seen(rows)), "day", market_table(spark, sf_dir, e).select("day", "regime"), ("regime",))
    f = f.join(e.select("symbol", F.col("idx").alias("d"), "atr"), ["symbol", "d"]).withColumn("scan_day", F.col("day"))
    bottom = F.filter("anchors", lambda a: a["label"] == "bottom")[0]["price"]
    return outcomes.scored(f.withColumn("cup_bottom", F.when(F.col("pattern") == CUP, bottom)).withColumn("cup_trigger", F.col("trigger")), e), e


_SCORED = [MARKET, f"""rf AS (SELECT rl.*, rl.day AS scan_day, e.atr, cb.target_at AS cup_bottom, rl.trigger AS cup_trigger, (SELECT max_by(regime, day) FROM market m WHERE m.day <= rl.day AND regime IS NOT NULL) AS regime
  FROM rl JOIN e ON e.symbol = rl.symbol AND e.idx = rl.d LEFT JOIN (SELECT DISTINCT symbol, cand, target_at FROM cand_cup) cb ON rl.pattern = '{CUP}' AND cb.symbol = rl.symbol AND cb.cand = rl.cand WHERE rl.day = first_day)""", _fate_of("rf")]
_SLICED = """CASE k.kind WHEN 'overall' THEN 'all' WHEN 'pattern' THEN pattern WHEN 'regime' THEN regime
  ELSE CASE WHEN score <= 69 THEN '60-69' WHEN score <= 79 THEN '70-79' WHEN score <= 89 THEN '80-89' ELSE '90-100' END END"""
_KINDS = "(VALUES ('overall'), ('pattern'), ('score'), ('regime')) k(kind)"
_SPLIT = "1996-01-01"
_LABELS = f"(VALUES ('all sessions'), ('before {_SPLIT}'), ('from {_SPLIT}')) w(label)"
_ON_SIDE = f"(label = 'all sessions' OR (label LIKE 'before%') = (scan_day < DATE '{_SPLIT}'))"


@query(o.with_(o.BARS, _replay_sql(), *_SCORED) + f"SELECT kind, slice, {_STATS} FROM (SELECT f.*, k.kind, {_SLICED} AS slice FROM fate f, {_KINDS}) WHERE slice IS NOT NULL GROUP BY kind, slice")
def signal_breakdown(spark, sf_dir):
    """What became of the detectors' first reports: overall, by pattern, score and regime."""
    return outcomes.breakdown(_first_scored(spark, sf_dir)[0])


_SECTIONS = f"""sl AS (SELECT label || '|' || kind || '|' || slice AS part, * FROM (SELECT f.*, w.label, k.kind, {_SLICED} AS slice FROM fate f, {_KINDS}, {_LABELS} WHERE {_ON_SIDE}) WHERE slice IS NOT NULL),
sd AS (SELECT part, {o.r('min(cum - peak)', 3)} AS max_dd FROM (SELECT part, cum, greatest(max(cum) OVER (PARTITION BY part ORDER BY scan_day, symbol, pattern, stop), 0.0) AS peak FROM
  (SELECT *, sum(r) OVER (PARTITION BY part ORDER BY scan_day, symbol, pattern, stop) AS cum FROM sl WHERE r IS NOT NULL)) GROUP BY part),
{bootstrap_sql("sl", "part", "bt", "scan_day, symbol, pattern, stop")}"""


@query(o.with_(o.BARS, _replay_sql(), *_SCORED, _SECTIONS) + f"SELECT x.* EXCLUDE (part), max_dd, ci_low, ci_high, dd_p95 FROM (SELECT part, label, kind, slice, {_STATS} FROM sl GROUP BY part, label, kind, slice) x LEFT JOIN sd USING (part) LEFT JOIN bt USING (part)")
def report_sections(spark, sf_dir):
    """The first reports of all sessions and of both sides of a split day: statistics, drawdown and month-block interval of
    every slice."""
    rows = outcomes.slices(replay.windows(_first_scored(spark, sf_dir)[0], "day", _SPLIT))
    return outcomes.reported(rows, ("label", "kind", "slice"), ("symbol", "pattern", "stop"))


def _labelled(text):
    """The SQL of the grid or the horizons over first reports, with their labels."""
    return text.replace("f.symbol, f.d, f.pattern,", "f.label, f.symbol, f.d, f.pattern,").replace("FROM fate f,", "FROM lf f,")


_LF = f"lf AS (SELECT fate.*, w.label FROM fate, {_LABELS} WHERE {_ON_SIDE})"
_HOR_L = (_labelled(_HOR).replace("SELECT symbol, d, pattern, horizon, any", "SELECT label, symbol, d, pattern, horizon, any").replace("FROM hw GROUP BY 1, 2, 3, 4)", "FROM hw GROUP BY 1, 2, 3, 4, 5)"))
_GRID_L = (_labelled(_GRID).replace("SELECT symbol, d, extra, basis, mode, min", "SELECT label, symbol, d, pattern, extra, basis, mode, min").replace("FROM vw GROUP BY 1, 2, 3, 4, 5)", "FROM vw GROUP BY 1, 2, 3, 4, 5, 6, 7)")
           .replace("ON vw.symbol = vh.symbol", "ON vw.label = vh.label AND vw.pattern = vh.pattern AND vw.symbol = vh.symbol"))


@query(o.with_(o.BARS, _replay_sql(), *_SCORED, _LF, _HOR_L) + f"SELECT label, {_HORIZONS} FROM ha GROUP BY label, slice, horizon")
def report_horizons(spark, sf_dir):
    """The horizon table of first reports, for all sessions and both sides of a split day."""
    f, e = _first_scored(spark, sf_dir)
    return outcomes.horizon_table(replay.windows(f, "day", _SPLIT), e, by=("label",))


@query(o.with_(o.BARS, _replay_sql(), *_SCORED, _LF, _GRID_L) + f"SELECT label, extra, basis, mode, {_SUMMARY}, {_MEANS} FROM gr GROUP BY label, extra, basis, mode")
def report_grid(spark, sf_dir):
    """First reports scored again under every stop and target variant, for all sessions and both sides of a split day."""
    f, e = _first_scored(spark, sf_dir)
    return outcomes.grid(replay.windows(f, "day", _SPLIT), e, by=("label",))


@query(o.with_(o.BARS, E, o.cup_pairs(profile())) + f"SELECT c.symbol, a, b, {o.r('avg(volume) FILTER (WHERE idx > b)/avg(volume) FILTER (WHERE idx <= b)', 3)} AS handle_volume_ratio, {o.r('regr_slope(CASE WHEN idx > b THEN volume END, idx)/avg(volume) FILTER (WHERE idx > b)', 4)} AS handle_volume_slope FROM cup_pairs c JOIN e ON e.symbol = c.symbol AND e.idx BETWEEN a AND b + 8 GROUP BY 1, 2, 3")
def cup_volume_features(spark, sf_dir):
    """The volume of the eight bars after the right rim against the cup's."""
    e = enriched(spark, sf_dir)
    c = det.cup_pairs(e, Fixed(profile(), CUP)).select("symbol", "a", "b")
    v = F.when(F.col("j") > F.col("b"), F.col("jvolume"))
    ratio = F.avg(v) / F.avg(F.when(F.col("j") <= F.col("b"), F.col("jvolume")))
    return det.interval(c, e, F.col("a"), F.col("b") + 8, r(ratio, 3).alias("handle_volume_ratio"), r(F.regr_slope(v, F.col("j")) / F.avg(v), 4).alias("handle_volume_slope")).select("symbol", "a", "b", "handle_volume_ratio", "handle_volume_slope")


# Report tables ------------------------------------------------------------------------------------------------------------

@query(_l("SELECT symbol, run, pattern, stop, status, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN status = 'CONFIRMED' THEN 0 ELSE 1 END, score DESC, symbol, pattern, d, stop) AS place FROM slog"))
def signals_ranked(spark, sf_dir):
    return marts.ranked(signal_log(spark, sf_dir)).select("symbol", "run", "pattern", "stop", "status", "place")


_SKIP = _case("pattern", {CUP: 7, IHS: 7, WOLFE: 6, DOUBLE: 7})


@query(_l(f"""SELECT symbol, run, pattern, stop, CASE WHEN listed_day IS NULL OR listed_day < 3 THEN 'enter' WHEN listed_day >= {_SKIP} THEN 'skip' ELSE 'late' END AS grade,
  CASE WHEN listed_day IS NULL THEN 'First report unknown' WHEN listed_day = 1 THEN 'New today' WHEN listed_day >= {_SKIP} THEN 'Day ' || listed_day || ': too late to enter' WHEN listed_day < 3 THEN 'Day ' || listed_day || ' of ' || {_LIMIT} ELSE 'Day ' || listed_day || ' of ' || {_LIMIT} || ': late, smaller edge' END AS status_text FROM listed""", _LISTED))
def grade_by_day(spark, sf_dir):
    s = lifecycle.listings(signal_log(spark, sf_dir), TUNED)
    g, text = marts.grade(F.col("pattern"), F.col("listed_day"), lifecycle.limit(TUNED))
    return s.select("symbol", "run", "pattern", "stop", g.alias("grade"), text.alias("status_text"))


@query(_l("""SELECT l.symbol, l.run, l.pattern, l.stop, l.status, CAST(coalesce(l.listed_day, CASE WHEN h.last_listed = l.day THEN h.n END) AS INT) AS day_on FROM listed l LEFT JOIN
  (SELECT symbol, pattern, stop, count(DISTINCT day) AS n, max(day) AS last_listed FROM slog WHERE status = 'CONFIRMED' GROUP BY 1, 2, 3) h ON h.symbol = l.symbol AND h.pattern = l.pattern AND h.stop = l.stop""", _LISTED))
def day_on_list(spark, sf_dir):
    s = signal_log(spark, sf_dir)
    return marts.day_on_list(lifecycle.listings(s, TUNED), lifecycle.history(s)).select("symbol", "run", "pattern", "stop", "status", F.col("day_on").cast("int").alias("day_on"))


@query(_l(f"""SELECT symbol, run, pattern, stop, status, CASE WHEN bars_since_break IS NULL THEN '-' ELSE bars_since_break || '/' || {_AGE} END AS age, CASE WHEN listed_day IS NULL THEN '-' ELSE listed_day || '/' || {_LIMIT} END AS on_list FROM listed WHERE state = 'kept'""", _LISTED))
def report_rows(spark, sf_dir):
    s = lifecycle.listings(signal_log(spark, sf_dir), TUNED).filter("state = 'kept'")
    return marts.report_rows(s, lifecycle.age_limit(TUNED), lifecycle.limit(TUNED)).select("symbol", "run", "pattern", "stop", "status", "age", "on_list")


@query(_p(f"""SELECT symbol, d, {o.r("-" + o.r('(stop/entry - 1)*100', 1), 1)} AS risk_pct, {o.r('(target/entry - 1)*100', 1)} AS reward_pct,
  array_to_string(list_filter(list_concat([CASE WHEN regime IS NOT NULL THEN 'Market: ' || regime || ' trend' END], list_transform(string_split(trend, ', '), lambda p: upper(p[1]) || p[2:]),
    [CASE WHEN vr >= 1 THEN 'Breakout volume ' || printf('%.2f', vr) || '× the average' WHEN vr < 1 THEN 'Breakout volume ' || printf('%.2f', vr) || '×, below average' END]), lambda x: x IS NOT NULL), '; ') AS chips
  FROM pos JOIN (SELECT symbol, idx AS d, vr, trend FROM e) USING (symbol, d)"""))
def setup_view(spark, sf_dir):
    e = enriched(spark, sf_dir)
    p = positions(spark, sf_dir, e).join(e.select("symbol", F.col("idx").alias("d"), F.col("vr").alias("volume_ratio"), "trend"), ["symbol", "d"]).withColumn("day", F.col("scan_day"))
    key = p.select("symbol", F.col("d"), "day")
    return marts.setup_view(p).join(key, ["symbol", "day"]).select("symbol", "d", "risk_pct", "reward_pct", "chips")


@query(_l(f"SELECT symbol, run, pattern, entry AS trigger, {o.r('(entry/last_close - 1)*100', 1)} AS to_trigger_pct FROM slog WHERE status = 'WATCHLIST'"))
def watch_view(spark, sf_dir):
    s = signal_log(spark, sf_dir).filter("status = 'WATCHLIST'")
    return s.select("symbol", "run", "pattern", F.col("entry").alias("trigger"), marts.percent(F.col("entry"), F.col("last_close")).alias("to_trigger_pct"))


_EVAL = f"ev AS (SELECT *, CASE WHEN outcome = 'open' AND n >= 40 THEN 'expired' ELSE outcome END AS o2, {o.r('(exit/fill - 1)*100', 2)} AS pnl FROM fate), lb AS (SELECT *, CASE WHEN o2 = 'target' THEN 'win' WHEN o2 = 'stop' THEN 'loss' WHEN o2 = 'expired' THEN CASE WHEN pnl > 0 THEN 'win' WHEN pnl < 0 THEN 'loss' ELSE 'flat' END WHEN o2 = 'open' THEN 'open' WHEN o2 IN ('gap', 'below_stop') THEN 'none' ELSE 'pending' END AS label FROM ev)"


def _evaluated(spark, sf_dir):
    e = enriched(spark, sf_dir)
    f = outcomes.fill_and_resolve(positions(spark, sf_dir, e), e, 40, expire=True)
    return f.withColumn("pnl_pct", r((F.col("exit") / F.col("fill") - 1) * 100, 2))


@query(_p("SELECT symbol, d, label FROM lb", FATE, _EVAL))
def result_labels(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("symbol", "d", marts.result_label(F.col("outcome"), F.col("pnl_pct")).alias("label"))


@query(_p(f"""SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE label = '{k}') AS {v}" for k, v in (("win", "wins"), ("loss", "losses"), ("flat", "flat"), ("open", "open"), ("none", "not_bought"), ("pending", "pending")))},
  {o.r("avg(pnl) FILTER (WHERE o2 IN ('target', 'stop', 'expired'))", 1)} AS avg_pnl_pct FROM lb""", FATE, _EVAL))
def results_tally(spark, sf_dir):
    return marts.tally(_evaluated(spark, sf_dir))


@query(_p(f"""SELECT symbol, d, pattern, CASE WHEN o2 IN ('target', 'stop', 'expired') THEN 'closed' WHEN o2 = 'open' THEN 'open' ELSE 'none' END AS status,
  CASE WHEN r IS NOT NULL THEN {o.r('sum(r) OVER (PARTITION BY pattern ORDER BY scan_day, symbol, d)', 2)} END AS curve FROM ev""", FATE, _EVAL))
def track_view(spark, sf_dir):
    return marts.track(_evaluated(spark, sf_dir), ("pattern",)).select("symbol", "d", "pattern", "status", "curve")


@query(o.with_(o.BARS) + "SELECT symbol, array_to_string(list(CAST(day AS VARCHAR) ORDER BY idx), ',') AS dates, len(list(close)) AS n, list_sum(list(CAST(round(close*100) AS BIGINT))) AS cents FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS k FROM bars) WHERE k <= 60 GROUP BY symbol")
def chart_bars_arrays(spark, sf_dir):
    c = marts.chart_arrays(src.bars(spark, sf_dir), 60)
    return c.select("symbol", F.array_join("dates", ",").alias("dates"), F.size("close").alias("n"), F.aggregate("close", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 100).cast("long")).alias("cents"))


@query(o.with_(o.BARS) + "SELECT symbol, date_diff('day', max(day), DATE '2002-01-01') AS stale_days FROM bars GROUP BY symbol")
def stale_days(spark, sf_dir):
    return src.bars(spark, sf_dir).groupBy("symbol").agg(F.datediff(F.lit("2002-01-01").cast("date"), F.max("day")).alias("stale_days"))


#: Of each pattern's anchors the label, bar and price in its SQL.
_ANCHORS = {CUP: (("left rim", "a", "ra"), ("bottom", "bi", "bottom"), ("right rim", "b", "rb"), ("handle low", "hi_", "hl")), IHS: (("LS", "ls", "lv"), ("head", "h", "hv"), ("RS", "rs", "rv")),
            DOUBLE: (("L1", "l1", "v1"), ("peak", "p", "peak"), ("L2", "l2", "v2")), WOLFE: tuple((str(i), f"p{i}", f"v{i}") for i in range(1, 6))}


def _notes_sql():
    parts = [E]
    for f, _ in o.CANDIDATES.values():
        text = f(profile())
        parts.append(text.replace(f"\n{o._lows()},", "") if any(o._lows() in x for x in parts) else text)
    rows = [f"SELECT DISTINCT symbol, pattern, cand, known, '{label}' AS label, {at} AS at_, {price} AS price FROM {o.CANDIDATES[p][1]}" for p, anchors in _ANCHORS.items() for label, at, price in anchors]
    return o.with_(o.BARS, *parts, "an AS (" + " UNION ALL ".join(rows) + ")") + f"SELECT an.symbol, pattern, cand, known, label, day, {o.r('price', 2)} AS price FROM an JOIN e ON e.symbol = an.symbol AND e.idx = at_"


@query(_notes_sql())
def notes_pivots(spark, sf_dir):
    """The anchors of all candidates, written into notes and read back from the text."""
    e = enriched(spark, sf_dir)
    c = [det.candidates(e, profile(), p).select("symbol", "pattern", "cand", "known", "v0", "anchors") for p in det.PATTERNS]
    texts = marts.notes(written(c[0].unionByName(c[1]).unionByName(c[2]).unionByName(c[3])), e, ("symbol", "pattern", "cand", "known"))
    return marts.read_notes(texts)


_DOC = "day, pattern, status, entry, stop, target, score"


@query(_l(f"SELECT symbol, (SELECT count(*) FROM last_) AS \"rows\", day AS last_day, {_DOC} FROM last_", "last_ AS (SELECT * FROM slog WHERE day = (SELECT max(day) FROM slog))"))
def scan_document_json(spark, sf_dir):
    """The newest day's documents, one for each symbol, written as JSON and read again."""
    s = signal_log(spark, sf_dir)
    s = s.join(s.agg(F.max("day").alias("day")), "day", "left_semi")
    return marts.read_documents(marts.documents(s, s.agg(F.count("*").alias("rows"), F.max("day").alias("last_day"))))


@query(_p("SELECT symbol, (SELECT count(*) FROM ev) AS \"rows\", (SELECT max(scan_day) FROM ev) AS last_day, scan_day AS day, pattern, o2 AS status, entry, stop, target, score FROM ev", FATE, _EVAL))
def view_model_json(spark, sf_dir):
    """The positions of a symbol with their results as one document, read again."""
    f = _evaluated(spark, sf_dir).withColumn("day", F.col("scan_day")).withColumn("status", F.col("outcome"))
    return marts.read_documents(marts.documents(f, f.agg(F.count("*").alias("rows"), F.max("day").alias("last_day"))))


_RUNS = "runs AS (SELECT day, CASE WHEN day < DATE '1996-01-01' THEN 'spec' ELSE 'tuned' END AS profile FROM (SELECT DISTINCT day FROM bars))"


@query(o.with_(o.BARS, _RUNS) + "SELECT day, profile, lag(day) OVER (ORDER BY day) AS previous_run, lag(profile) OVER (ORDER BY day) AS previous_profile, coalesce(lag(profile) OVER (ORDER BY day) <> profile, false) AS profile_changed FROM runs")
def profile_changes(spark, sf_dir):
    """Runs whose rules differ from those of the run before; here the rules change once."""
    runs = src.bars(spark, sf_dir).select("day").distinct()
    return lifecycle.profile_changes(runs.withColumn("profile", F.when(F.col("day") < F.lit("1996-01-01").cast("date"), "spec").otherwise("tuned")))


@query(_FG + "," + o.scan_all("tuned", "x.idx = (SELECT max(idx) FROM e z WHERE z.symbol = x.symbol)") + " SELECT s.symbol, s.d, s.pattern, s.status, s.stop, g.fear_greed FROM allsig s LEFT JOIN fgs g ON g.symbol = s.symbol AND g.idx = s.d")
def scan_last_bar_mood(spark, sf_dir):
    """The nightly scan with the fear-greed reading of each symbol."""
    e = enriched(spark, sf_dir, TUNED)
    mood = ind.with_fear_greed(src.bars(spark, sf_dir))
    return det.scan(e, TUNED, days=det.last_bars(e), mood=mood).select("symbol", "d", "pattern", "status", "stop", "fear_greed")


# Streams ------------------------------------------------------------------------------------------------------------------

_TR = "tr AS (SELECT CAST(l_suppkey AS BIGINT) AS symbol, l_shipdate AS ts, l_extendedprice/l_quantity AS price, l_quantity AS quantity FROM lineitem)"


@query(o.with_(_TR) + f"""SELECT symbol, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, max(price) AS high, min(price) AS low, sum(quantity) AS volume FROM tr GROUP BY 1, 2""")
def stream_tumbling_bars(spark, sf_dir):
    """Weekly bars by event time; the same function runs on a stream (see tests)."""
    return streaming.tumbling(src.trades(spark, sf_dir)).select("symbol", "start", "high", "low", "volume")


@query(o.with_(_TR, "g AS (SELECT symbol, ts, sum(CASE WHEN ts > lag_ + INTERVAL 5 DAY OR lag_ IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS lag_ FROM tr))")
       + "SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 5 DAY AS \"end\", count(*) AS trades FROM g GROUP BY symbol, k")
def stream_session_bars(spark, sf_dir):
    return streaming.sessions(src.trades(spark, sf_dir))
