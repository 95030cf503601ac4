"""The store of runs with what accidents leave there, the list as a stream, membership intervals, notes."""

import datetime
import json
import os

from pyspark.sql import functions as F

from wickwork.functions.rules import CUP, DOUBLE, profile
from wickwork.operators import market, marts
from wickwork.sources import runs
from wickwork.streaming import listings


def log(spark):
    day = datetime.date(2001, 2, 5)
    data = [(run, s, day + datetime.timedelta(7 * run), "Double Bottom", "CONFIRMED", 10.0 + run, 9.0, 12.5, 70 + run) for run in (1, 2, 3) for s in (4, 5)]
    return spark.createDataFrame(data, "run long, symbol long, day date, pattern string, status string, entry double, stop double, target double, score int")


def test_store_reads_the_rest(spark, tmp_path):
    path = str(tmp_path / "store")
    runs.write(runs.documents(log(spark), "tuned"), path)
    with open(f"{path}/run=2/broken.json", "w") as f:
        f.write('{"version": 2, "symbol": "9", "signals": [{"pat\nnot a document\n[]\n{"version": 2}\n' + json.dumps({"ticker": "OLD", "signals": [{"pattern": "Double Bottom", "status": "CONFIRMED", "stop": 1.5}]}) + "\n")
    os.makedirs(f"{path}/run=9")
    open(f"{path}/run=9/empty.json", "w").close()
    got = runs.signals(runs.read(spark, path))
    assert got.count() == 7
    old = got.filter("symbol = 'OLD'").first()
    assert (old.run, old.stop, old.entry, old.profile, old.last_date) == (2, 1.5, None, None, None)
    assert {r.run for r in runs.unreadable(spark, path).collect()} == {2} and runs.unreadable(spark, path).count() >= 3
    assert runs.read(spark, path).filter("symbol = 'OLD'").first().closed == []


def test_latest_run_and_pruning(spark, tmp_path):
    path = str(tmp_path / "store")
    runs.write(runs.documents(log(spark), "spec"), path)
    assert {r.run for r in runs.latest(spark, path).collect()} == {3} and {r.run for r in runs.latest(spark, path, 3).collect()} == {2}
    plan = runs.read(spark, path).filter("run = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "(run#" in plan
    # A run written again replaces itself and nothing else.
    again = log(spark).filter("run = 2 and symbol = 4").withColumn("score", F.lit(99))
    runs.write(runs.documents(again, "tuned"), path)
    got = sorted((r.run, r.symbol, r.score) for r in runs.signals(runs.read(spark, path)).collect())
    assert got == [(1, "4", 71), (1, "5", 71), (2, "4", 99), (3, "4", 73), (3, "5", 73)]
    assert runs.latest(spark, path, 1).count() == 0


def test_stream_remembers_over_restarts_and_forgets_by_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", listings.PROVIDER)
    rules = profile("tuned")
    start = datetime.date(2001, 1, 1)
    signal = lambda status, stop, since: {"pattern": DOUBLE, "status": status, "entry": 100.0, "stop": stop, "target": 120.0, "bars_since_break": since}

    def feed(rows):
        spark.createDataFrame([(s, run, start + datetime.timedelta(days), float(high), float(close), signals) for s, run, days, high, close, signals in rows], listings.RUN).write.mode("append").parquet(f"{tmp_path}/runs")
        q = listings.follow(spark.readStream.schema(listings.RUN).parquet(f"{tmp_path}/runs"), rules).writeStream.format("parquet").option("path", f"{tmp_path}/events").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)

    feed([(1, 0, 0, 101, 100, [signal("WATCHLIST", 90.0, None)]), (1, 1, 7, 101, 101, [signal("CONFIRMED", 90.0, 0)]), (2, 0, 0, 50, 50, [signal("CONFIRMED", 40.0, 1)])])
    feed([(1, 2, 14, 103, 102, [signal("CONFIRMED", 90.0, 1)]), (1, 3, 21, 121, 110, [])])
    feed([(1, 4, 120, 99, 98, [])])
    feed([(1, 5, 127, 99, 98, [])])
    e = sorted((r.symbol, r.run, r.event, r.first_listed or "", r.listed_day or 0, r.outcome or "", -1 if r.bars is None else r.bars) for r in spark.read.schema(listings.EVENT).parquet(f"{tmp_path}/events").collect())
    assert e == [(1, 0, "kept", "", 0, "", -1), (1, 1, "kept", "2001-01-08", 1, "", -1), (1, 2, "closed", "", 0, "TARGET_REACHED", 1), (1, 2, "kept", "2001-01-08", 2, "", -1),
                 (2, 0, "closed", "", 0, "DROPPED", 0), (2, 0, "kept", "2001-01-01", 1, "", -1)]


def test_limits_retire_and_stay_silent():
    limits, ages = {DOUBLE: 2, CUP: None}, {DOUBLE: 8, CUP: 3}
    held, seen = {}, []
    for run in range(5):
        held, events = listings.advance(held, run, f"day {run}", 11.0, 10.0, [{"pattern": DOUBLE, "status": "CONFIRMED", "entry": 10.0, "stop": 9.0, "target": None, "bars_since_break": run}], limits, ages, 0.05)
        seen += [(e[4], e[5], e[6]) for e in events]
    assert seen == [("kept", "day 0", 1), ("kept", "day 0", 2), ("retired", "day 0", 3), ("silent", "day 0", 4), ("silent", "day 0", 5)]
    held, events = listings.advance(held, 9, "day 9", 11.0, 8.0, [], limits, ages, 0.05)
    assert [e[7] for e in events] == ["FAILED"] and held["known"] == {}


def test_intervals_of_membership(spark):
    d = lambda y: datetime.date(y, 1, 1)
    s = spark.createDataFrame([(d(y), x) for x, years in {1: (2000, 2001, 2003), 2: (2001,), 3: (2003,)}.items() for y in years] + [(d(2000), 1), (d(2002), 9)], "snapshot_date date, symbol long")
    got = sorted((r.symbol, str(r.valid_from), str(r.valid_to)) for r in market.intervals(s).collect())
    assert got == [(1, "0001-01-01", "2001-12-31"), (1, "2003-01-01", "9999-12-31"), (2, "2001-01-01", "2001-12-31"), (3, "2003-01-01", "9999-12-31"), (9, "2002-01-01", "2002-12-31")]
    rows = spark.createDataFrame([(1, d(2002)), (1, d(1990)), (2, d(2001)), (3, d(2024))], "symbol long, day date")
    assert sorted((r.symbol, r.day.year) for r in market.only_members(rows, "day", s).collect()) == [(1, 1990), (2, 2001), (3, 2024)]
    assert market.members(rows.select("day").distinct(), s).filter("symbol = 1").count() == 3


def test_notes_in_older_words(spark):
    texts = [(1, "LS 2001-02-05 @32.88, head on 2001-03-05 at 30.1, RS 2001-04-02 @ 33; trigger 35.00"), (2, "nothing to read @5"), (3, None), (4, "left rim 1999-12-31 @7")]
    got = sorted((r.id, r.label, str(r.day), r.price) for r in marts.read_notes(spark.createDataFrame(texts, "id long, notes string")).collect())
    assert got == [(1, "LS", "2001-02-05", 32.88), (1, "RS", "2001-04-02", 33.0), (1, "head", "2001-03-05", 30.1), (4, "left rim", "1999-12-31", 7.0)]
