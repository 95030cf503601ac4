"""A structure that one run has twice, watched and confirmed at the same stop, as the SQL lists it."""

import datetime
from itertools import groupby

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_queries import plain
from wickwork.functions.rules import DOUBLE, PATTERNS, WOLFE, max_age, profile
from wickwork.operators import lifecycle, marts
from wickwork.plans import nights
from wickwork.streaming import listings

TUNED = profile("tuned")
COLUMNS = "symbol long, run long, d int, day date, pattern string, status string, entry double, stop double, target double, score int, bars_since_break int"


def rows():
    """(run, watched, confirmed) by symbol and pattern: twice in the middle, at the start, after the limit, and over a gap."""
    both, watched, confirmed = (True, True), (True, False), (False, True)
    logs = {
        (1, DOUBLE): {1: watched, 2: both, 3: confirmed, 4: confirmed, 5: watched, 6: confirmed, 7: confirmed, 8: confirmed, 9: confirmed},
        (2, DOUBLE): {1: confirmed, 2: confirmed, 3: confirmed, 4: confirmed, 5: confirmed, 6: confirmed, 7: confirmed, 8: both, 9: watched, 10: both},
        (3, DOUBLE): {1: both, 2: watched, 3: confirmed, 6: both, 7: both},
        (4, WOLFE): {1: watched, 2: watched, 3: both, 4: watched, 5: confirmed},
    }
    day = datetime.date(2001, 1, 1)
    out = []
    for (symbol, pattern), runs in logs.items():
        for run, there in runs.items():
            out += [(symbol, run, run, day + datetime.timedelta(7 * run), pattern, status, 100.0, 90.0, 120.0, 70, 0 if status == "CONFIRMED" else None) for status, has in zip(("WATCHLIST", "CONFIRMED"), there) if has]
    return out


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(rows(), COLUMNS).coalesce(1)


@pytest.fixture(scope="module")
def sql(log):
    con = duckdb.connect()
    slog = log.withColumn("day", F.col("day").cast("string")).toPandas().astype({"bars_since_break": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE slog AS SELECT * REPLACE (CAST(day AS DATE) AS day) FROM slog")
    return lambda body: plain(con.execute(f"WITH {nights._LISTED} {body}").fetchdf())


def _body(name):
    """What follows the listings in a query's SQL."""
    return entry.oracle_sql()[name].split(nights._LISTED)[1]


def test_listings(log, sql):
    columns = "symbol, run, pattern, stop, status, first_listed, listed_day, state"
    assert plain(lifecycle.listings(log, TUNED).select(*columns.split(", ")).toPandas()) == sql(f"SELECT {columns} FROM listed")


def test_day_on_list(log, sql):
    columns = "symbol, run, pattern, stop, status, day_on"
    got = marts.day_on_list(lifecycle.listings(log, TUNED), lifecycle.history(log)).withColumn("day_on", F.col("day_on").cast("int"))
    assert plain(got.select(*columns.split(", ")).toPandas()) == sql(_body("day_on_list"))


def test_grade_by_day(log, sql):
    grade, text = marts.grade(F.col("pattern"), F.col("listed_day"), lifecycle.limit(TUNED))
    got = lifecycle.listings(log, TUNED).select("symbol", "run", "pattern", "stop", grade.alias("grade"), text.alias("status_text"))
    assert plain(got.toPandas()) == sql(_body("grade_by_day"))


def test_report_rows(log, sql):
    kept = lifecycle.listings(log, TUNED).filter("state = 'kept'")
    got = marts.report_rows(kept, lifecycle.age_limit(TUNED), lifecycle.limit(TUNED)).select("symbol", "run", "pattern", "stop", "status", "age", "on_list")
    assert plain(got.toPandas()) == sql(_body("report_rows"))


@pytest.mark.parametrize("watched_first", [True, False])
def test_stream_lists_as_the_batch(sql, watched_first):
    limits, ages = {p: TUNED["max_listed_days"].get(p) for p in PATTERNS}, {p: max_age(TUNED, p) for p in PATTERNS}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    got, held = [], {}
    for (symbol, run), of in groupby((dict(zip(names, x)) for x in rows()), key=lambda x: (x["symbol"], x["run"])):
        signals = sorted(of, key=lambda x: x["status"], reverse=watched_first)
        held[symbol], events = listings.advance(held.get(symbol, {}), run, str(signals[0]["day"]), 100.0, 100.0, signals, limits, ages, 0.05)
        got += [(symbol, *e[:7]) for e in events if e[4] != "closed"]
    d = pd.DataFrame(got, columns=["symbol", "run", "pattern", "stop", "status", "event", "first_listed", "listed_day"])
    assert plain(d) == sql("SELECT symbol, run, pattern, stop, status, state AS event, CAST(first_listed AS VARCHAR) AS first_listed, listed_day FROM listed")
