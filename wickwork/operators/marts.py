"""Report tables: grades, views, labels and nested documents over signals and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.columns import r
from wickwork.functions.indicators import fear_greed_zone
from wickwork.functions.rules import WOLFE
from wickwork.operators.outcomes import running

#: The texts of a grade.
TEXTS = {"unknown": "First report unknown", "new": "New today", "over": ": too late to enter", "late": ": late, smaller edge"}
#: The day from which an entry is late, and from which there is no edge left.
LATE_FROM, NO_ENTRY, NO_ENTRY_WOLFE = 3, 7, 6
CLOSED_ORDER = ("TARGET_REACHED", "FAILED", "EXPIRED", "RETIRED", "FADED", "DROPPED")


def percent(a: Column, b: Column) -> Column:
    return r((a / b - 1) * 100, 1)


def grade(pattern: Column, day: Column, limit: Column) -> tuple[Column, Column]:
    """(grade, status) by the day on the list."""
    last = F.when(pattern == WOLFE, NO_ENTRY_WOLFE).otherwise(NO_ENTRY)
    top = F.coalesce(limit, last - 1)
    nth = F.concat(F.lit("Day "), day.cast("string"))
    of = F.concat(nth, F.lit(" of "), top.cast("string"))
    cases = [(day.isNull(), "enter", F.lit(TEXTS["unknown"])), (day == 1, "enter", F.lit(TEXTS["new"])), (day < LATE_FROM, "enter", of),
             (day >= last, "skip", F.concat(nth, F.lit(TEXTS["over"])))]
    g, text = F.lit("late"), F.concat(of, F.lit(TEXTS["late"]))
    for holds, grade_, words in reversed(cases):
        g, text = F.when(holds, grade_).otherwise(g), F.when(holds, words).otherwise(text)
    return g, text


def day_on_list(signals: DataFrame, evaluation: DataFrame) -> DataFrame:
    """``signals`` with day_on: their own listed_day, else the track record's if it is as recent."""
    e = evaluation.select("symbol", "pattern", "stop", F.col("listed_days").alias("_days"), F.col("last_listed").alias("_last"))
    j = signals.join(e, ["symbol", "pattern", "stop"], "left")
    return j.withColumn("day_on", F.coalesce("listed_day", F.when(F.col("_last") == F.col("day"), F.col("_days")))).drop("_days", "_last")


#: An anchor in a note: label, day and price. Older notes write "on" before the day, "at" or a blank after the sign.
ANCHOR = r"([A-Za-z0-9][A-Za-z0-9 ]*?) (?:on )?(\d{4}-\d{2}-\d{2}) (?:@|at )\s?(\d+(?:\.\d+)?)"


def notes(rows: DataFrame, e: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key..., notes): what a row's anchors are, in words: label, day and price of each in order, then the trigger.

    ``rows`` have symbol, ``key`` (unique), anchors (label, idx, price) and v0 or trigger; days come from the bars ``e``.
    """
    level = "trigger" if "trigger" in rows.columns else "v0"
    days = e.select("symbol", F.col("idx").alias("_idx"), F.col("day").alias("_day"))
    a = rows.select("symbol", *[k for k in key if k != "symbol"], level, F.posexplode("anchors").alias("_at", "a")).withColumn("_idx", F.col("a.idx")).join(days, ["symbol", "_idx"])
    words = F.concat_ws(" ", "a.label", F.col("_day").cast("string"), F.concat(F.lit("@"), F.format_string("%.2f", "a.price")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", words.alias("words")))), lambda x: x["words"]), ", ")
    return a.groupBy(*key, level).agg(text.alias("_text")).select(*key, F.concat("_text", F.lit("; trigger "), F.format_string("%.2f", level)).alias("notes"))


def read_notes(rows: DataFrame, column: str = "notes") -> DataFrame:
    """``rows`` once for each anchor that a note names, with label, day and price; a note without any gives no rows."""
    found = F.arrays_zip(*[F.regexp_extract_all(column, F.lit(ANCHOR), F.lit(k)).alias(n) for k, n in ((1, "label"), (2, "day"), (3, "price"))])
    out = rows.withColumn("_a", F.explode(found)).drop(column)
    return out.select(*[c for c in out.columns if c != "_a"], F.col("_a.label").alias("label"), F.to_date("_a.day").alias("day"), F.col("_a.price").cast("double").alias("price"))


def chips(s: DataFrame) -> Column:
    """What a page says of a row beside its levels: the market's trend, the row's own, its volume, and fear and greed if given."""
    market_ = F.when(F.col("regime").isNotNull(), F.concat(F.lit("Market: "), "regime", F.lit(" trend")))
    own = F.transform(F.split(F.coalesce("trend", F.lit("")), ", "), lambda p: F.when(p != "", F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))))
    times = F.concat(F.lit("Breakout volume "), F.format_string("%.2f", "volume_ratio"))
    volume = F.when(F.col("volume_ratio") >= 1, F.concat(times, F.lit("× the average"))).when(F.col("volume_ratio") < 1, F.concat(times, F.lit("×, below average")))
    mood = F.lit(None).cast("string")
    if "fear_greed" in s.columns:
        mood = F.when(F.col("fear_greed").isNotNull(), F.concat(F.lit("Fear and greed "), F.format_string("%.0f", "fear_greed"), F.lit(", "), fear_greed_zone(F.col("fear_greed"))))
    return F.array_compact(F.concat(F.array(market_), own, F.array(volume, mood)))


def setup_view(s: DataFrame) -> DataFrame:
    """Confirmed rows as a page shows them."""
    return s.select("symbol", "pattern", "day", "score", "entry", "stop", "target", r(-percent(F.col("stop"), F.col("entry")), 1).alias("risk_pct"),
                    percent(F.col("target"), F.col("entry")).alias("reward_pct"), F.array_join(chips(s), "; ").alias("chips"))


def watch_view(s: DataFrame) -> DataFrame:
    return s.select("symbol", "pattern", "day", F.col("entry").alias("trigger"), "last_close", percent(F.col("entry"), F.col("last_close")).alias("to_trigger_pct"))


def result_label(outcome: Column, pnl: Column) -> Column:
    return (F.when(outcome == "target", "win").when(outcome == "stop", "loss").when(outcome == "expired", F.when(pnl > 0, "win").when(pnl < 0, "loss").otherwise("flat"))
            .when(outcome == "open", "open").when(outcome.isin("gap", "below_stop"), "none").otherwise("pending"))


def tally(rows: DataFrame) -> DataFrame:
    """One row of counts by label and the mean result of closed positions; rows have outcome and pnl_pct."""
    x = rows.withColumn("label", result_label(F.col("outcome"), F.col("pnl_pct")))
    n = lambda label: F.count_if(F.col("label") == label)
    closed = F.col("outcome").isin("target", "stop", "expired")
    return x.agg(F.count("*").alias("n"), n("win").alias("wins"), n("loss").alias("losses"), n("flat").alias("flat"), n("open").alias("open"), n("none").alias("not_bought"), n("pending").alias("pending"),
                 r(F.avg(F.when(closed, F.col("pnl_pct"))), 1).alias("avg_pnl_pct"))


def track(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows with status and, where traded, the running sum of R within ``by``."""
    status = F.when(F.col("outcome").isin("target", "stop", "expired"), "closed").when(F.col("outcome") == "open", "open").otherwise("none")
    x = rows.withColumn("status", status).withColumn("_r", F.col("r")).withColumn("r", F.when(F.col("status") != "none", F.col("r")))
    x = running(x, by, "scan_day", ("symbol", "d")).withColumn("r", F.col("_r"))
    return x.withColumn("curve", F.when((F.col("status") != "none") & F.col("r").isNotNull(), r(F.col("cum"), 2))).drop("_r", "cum", "peak")


def report_rows(s: DataFrame, age_limit: Column, day_limit: Column) -> DataFrame:
    """Formatted cells: age over its limit, day over its limit, a dash for nothing; in report order."""
    cell = lambda v, top: F.when(v.isNull(), "-").otherwise(F.concat_ws("/", v.cast("string"), top.cast("string")))
    dash = lambda v: F.coalesce(v.cast("string"), F.lit("-"))
    return s.withColumn("age", cell(F.col("bars_since_break"), age_limit)).withColumn("on_list", cell(F.col("listed_day"), day_limit)).withColumn("rr", dash(F.col("score")))


def ranked(s: DataFrame) -> DataFrame:
    """Confirmed first, then by score; equal scores by symbol, pattern and bar."""
    w = Window.partitionBy("run").orderBy(F.col("status") != "CONFIRMED", F.desc("score"), "symbol", "pattern", "d", "stop")
    return s.withColumn("place", F.row_number().over(w))


def chart_arrays(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol as parallel arrays."""
    w = Window.partitionBy("symbol").orderBy(F.desc("idx"))
    b = bars.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    rows = F.sort_array(F.collect_list(F.struct("idx", "day", "open", "high", "low", "close")))
    out = b.groupBy("symbol").agg(rows.alias("x"))
    prices = lambda c: F.transform("x", lambda v: r(v[c], 2)).alias(c)
    return out.select("symbol", F.transform("x", lambda v: v["day"].cast("string")).alias("dates"), *map(prices, ("open", "high", "low", "close")))


def documents(s: DataFrame, meta: DataFrame) -> DataFrame:
    """One JSON document per symbol: its signals in order, with the run's meta row (one row)."""
    item = F.struct("day", "pattern", "status", "entry", "stop", "target", "score")
    d = s.groupBy("symbol").agg(F.sort_array(F.collect_list(item)).alias("signals"))
    meta = F.broadcast(meta.select(F.struct(*meta.columns).alias("meta")))
    return d.crossJoin(meta).select("symbol", F.to_json(F.struct("meta", "signals")).alias("document"))


#: The types of a document's fields.
DOCUMENT = "meta struct<rows: long, last_day: date>, signals array<struct<day: date, pattern: string, status: string, entry: double, stop: double, target: double, score: int>>"


def read_documents(texts: DataFrame, column: str = "document") -> DataFrame:
    """The rows of JSON documents, each with ``symbol`` and the document's meta; a text that is no document gives no rows."""
    d = texts.withColumn("_d", F.from_json(column, DOCUMENT, {"mode": "PERMISSIVE"})).filter("_d.signals is not null")
    return d.select("symbol", "_d.meta.rows", "_d.meta.last_day", F.explode("_d.signals").alias("_s")).select("symbol", "rows", "last_day", "_s.*")
