"""Night-over-night state, for a whole log of runs at once.

A log holds the signals of every run: (symbol, run, d, day, pattern, status, ...), where ``run`` numbers the runs and d is the
bar that a symbol's run looks at. Each operator relates a run to the one before it by a join or a window on the structure's
key (symbol, pattern, stop), so one night and ten years of nights are the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.columns import true
from wickwork.functions.rules import PATTERNS, max_age
from wickwork.operators.outcomes import at, first, paths, seen

KEY = ("symbol", "pattern", "stop")


def _per_pattern(rules: dict, what) -> F.Column:
    out = F.lit(None).cast("int")
    for p in PATTERNS:
        v = what(p)
        if v is not None:
            out = F.when(F.col("pattern") == p, F.lit(v)).otherwise(out)
    return out


def limit(rules: dict):
    return _per_pattern(rules, lambda p: rules["max_listed_days"].get(p))


def age_limit(rules: dict):
    return _per_pattern(rules, lambda p: max_age(rules, p))


def listings(log: DataFrame, rules: dict) -> DataFrame:
    """``log`` with first_listed, listed_day and state: kept, retired (this run) or silent (retired before).

    A structure is followed as long as each next run produces it; its first confirmed report starts the count of the
    symbol's own bars, and a confirmed row past its pattern's limit is retired until the structure is no longer produced.
    A run may have a structure twice, watched and confirmed: both rows are listed alike, and the count starts anew with them.
    """
    w = Window.partitionBy(*KEY).orderBy("run")
    island = F.sum(F.when(F.lag("run").over(w) == F.col("run") - 1, 0).otherwise(1)).over(w)
    i = Window.partitionBy(*KEY, "island").orderBy("run").rangeBetween(Window.unboundedPreceding, 0)  # both rows of a run see each other
    confirmed = F.col("status") == "CONFIRMED"
    g = log.withColumn("island", island).withColumn("first_d", F.min(F.when(confirmed, F.col("d"))).over(i)).withColumn("first_listed", F.min(F.when(confirmed, F.col("day"))).over(i))
    g = g.withColumn("listed_day", (F.col("d") - F.col("first_d") + 1).cast("int"))
    over = true(confirmed & (F.col("listed_day") > limit(rules)))
    g = g.withColumn("retired_at", F.min(F.when(over, F.col("run"))).over(i))
    state = F.when(F.col("retired_at").isNull(), "kept").when(F.col("retired_at") == F.col("run"), "retired").otherwise("silent")
    return g.withColumn("state", state).drop("island", "first_d", "retired_at")


def vanished(log: DataFrame) -> DataFrame:
    """Rows of a run whose (symbol, pattern) the symbol's next run does not have."""
    following = log.select("symbol", "pattern", (F.col("run") - 1).alias("run")).distinct()
    return log.join(following, ["symbol", "pattern", "run"], "left_anti")


def close_out(log: DataFrame, bars: DataFrame, rules: dict, step: int) -> DataFrame:
    """Why each vanished row went, from the ``step`` bars after it: FAILED (a close at or below the stop) before
    TARGET_REACHED (a high at or above the target) on one bar; else EXPIRED, FADED or DROPPED; since, bars, hit_day."""
    v = vanished(log)
    g = paths(v, bars, step).withColumn("n", seen().cast("long"))
    g = g.withColumn("_f", first("close", lambda x: x <= F.col("stop"))).withColumn("_t", first("high", lambda x: x >= F.col("target")))
    failed = (F.col("_f") > 0) & ((F.col("_t") == 0) | (F.col("_f") <= F.col("_t")))
    aged = (F.col("status") == "CONFIRMED") & (F.col("bars_since_break") + F.col("n") > age_limit(rules))
    last = at(seen(), "close")
    outcome = (F.when(F.col("n") == 0, "DROPPED").when(failed, "FAILED").when(F.col("_t") > 0, "TARGET_REACHED").when(true(aged), "EXPIRED")
               .when(last < F.col("entry") * (1 - rules["watch_proximity"]), "FADED").otherwise("DROPPED"))
    g = g.withColumn("outcome", outcome).withColumn("hit_day", at(F.when(failed, F.col("_f")).otherwise(F.col("_t")), "day"))
    return g.withColumnRenamed("n", "bars").select(*v.columns, "bars", "outcome", "hit_day")


def drop_reason(rows: DataFrame, rules: dict, step: int) -> DataFrame:
    """``reason`` for DROPPED rows: the reward or the patience rule where one of them would explain it."""
    rr, wait = rules["min_reward_risk"], rules["max_wait_bars"]
    reason = F.lit("pattern no longer qualifies")
    if wait is not None:
        reason = F.when((F.col("status") == "WATCHLIST") & (F.col("d") + step - F.col("last") > wait), "no breakout in time").otherwise(reason)
    if rr is not None:
        reason = F.when(true(F.col("reward_risk") < rr), "reward below the minimum").otherwise(reason)
    return rows.withColumn("reason", reason)


def history(log: DataFrame) -> DataFrame:
    """Each confirmed structure's first appearance and the sorted distinct days it was listed."""
    w = F.struct("entry", "score", "target", "day")
    c = log.filter("status = 'CONFIRMED'")
    return c.groupBy(*KEY).agg(F.min_by(w, "run").alias("f"), F.array_sort(F.collect_set("day")).alias("days")).select(
        *KEY, "f.entry", "f.score", "f.target", F.col("f.day").alias("first_seen"), F.size("days").alias("listed_days"), F.element_at("days", -1).alias("last_listed"))


def demote(signals: DataFrame, rules: dict) -> DataFrame:
    """``signals`` with watch_only, and watch-only patterns' breakouts as WATCHLIST."""
    only = F.col("pattern").isin(*rules["watch_only"]) if rules["watch_only"] else F.lit(False)
    return signals.withColumn("watch_only", only).withColumn("status", F.when(only, "WATCHLIST").otherwise(F.col("status")))


def profile_changes(runs: DataFrame) -> DataFrame:
    """``runs`` (day, profile; one row a run) with previous_run, previous_profile and whether the rules have changed since."""
    w = Window.orderBy("day")
    return runs.select("day", "profile", F.lag("day").over(w).alias("previous_run"), F.lag("profile").over(w).alias("previous_profile"), F.coalesce(F.lag("profile").over(w) != F.col("profile"), F.lit(False)).alias("profile_changed"))
