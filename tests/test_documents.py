"""JSON documents: what is written is read back, and what is no document is passed over."""

import datetime

from wickwork.operators import marts


def test_documents_round_trip_and_unreadable_texts(spark):
    day = datetime.date(2001, 2, 5)
    rows = [(1, day, "Double Bottom", "CONFIRMED", 10.5, 9.25, None, 71), (1, day, "Cup & Handle", "WATCHLIST", 11.0, 9.0, 13.5, 80), (2, day, "Double Bottom", "CONFIRMED", 1.0, 0.5, 2.0, 60)]
    s = spark.createDataFrame(rows, "symbol long, day date, pattern string, status string, entry double, stop double, target double, score int")
    meta = spark.createDataFrame([(3, day)], "rows long, last_day date")
    docs = marts.documents(s, meta)
    assert docs.count() == 2
    broken = spark.createDataFrame([(3, "{not json"), (4, None), (5, "[]"), (6, "{}")], "symbol long, document string")
    got = marts.read_documents(docs.unionByName(broken)).collect()
    assert sorted((r.symbol, r.day, r.pattern, r.status, r.entry, r.stop, r.target, r.score) for r in got if r.target) == sorted(r for r in rows if r[6])
    assert len(got) == 3 and {(r.rows, r.last_day) for r in got} == {(3, day)}


def test_sinks(spark, tmp_path):
    from wickwork.sources.store import save

    s = spark.createDataFrame([(1, 2.5, datetime.date(2001, 2, 5))], "symbol long, r double, day date")
    for kind in ("json", "parquet"):
        save(s, f"{tmp_path}/{kind}", kind, by=("day",))
        back = spark.read.schema(s.schema).format(kind).load(f"{tmp_path}/{kind}")
        assert [tuple(r) for r in back.select("symbol", "r", "day").collect()] == [(1, 2.5, datetime.date(2001, 2, 5))]
