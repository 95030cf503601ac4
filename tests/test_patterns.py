"""Planted price series: each pattern is found, and broken ones are not."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wickwork.functions import indicators as ind
from wickwork.functions.rules import CUP, DOUBLE, IHS, PATTERNS, WOLFE, patterns, profile
from wickwork.operators import detectors as det


def path(*legs):
    """Straight legs (value, bars) from a first value."""
    out = [float(legs[0])]
    for value, bars in legs[1:]:
        out += np.linspace(out[-1], value, bars + 1)[1:].tolist()
    return out


def frame(spark, series: dict[str, list[float]], wick=0.002, loud_last=1):
    rows = []
    for symbol, close in series.items():
        close, n = [float(c) for c in close], len(close)
        days = pd.bdate_range(end="2025-06-02", periods=n)
        for i, c in enumerate(close):
            o = close[i - 1] if i else c
            rows.append((symbol, days[i].date(), i, o, max(o, c) * (1 + wick), min(o, c) * (1 - wick), c, 3e6 if i >= n - loud_last else 1e6))
    return spark.createDataFrame(rows, "symbol string, day date, idx int, open double, high double, low double, close double, volume double")


DOUBLE_BOTTOM = path(112, (120, 160), (84, 60), (80, 8), (92, 14), (81.5, 14), (92.3, 14), (92.6, 1))
HEAD = path(112, (120, 160), (92, 80), (80, 10), (90, 12), (70, 14), (90.5, 14), (81, 12), (90, 12), (92.5, 1), (93, 1))
CUP_PATH = [*path(40, (100, 220)), *[100 - 25 * np.sin(np.pi * k / 100) for k in range(1, 101)], *path(100, (94, 8), (97, 7), (101.5, 1), (102, 1))[1:]]

def found(spark, series, pattern, rules=None, status="CONFIRMED"):
    rules = rules or profile("tuned", min_reward_risk=None)
    e = ind.enrich(frame(spark, series), rules)
    return det.scan(e, rules, (pattern,)).filter(F.col("status") == status).select("symbol").distinct().toPandas()["symbol"].tolist()


def test_double_bottom(spark):
    broken = path(112, (120, 160), (84, 60), (80, 8), (92, 14), (70, 14), (92.3, 14), (92.6, 1))
    assert found(spark, {"good": DOUBLE_BOTTOM, "uneven": broken, "flat": [50.0] * 400, "line": path(50, (150, 300))}, DOUBLE) == ["good"]


def test_inverse_head_and_shoulders(spark):
    headless = path(112, (120, 160), (92, 80), (80, 10), (90, 12), (80.2, 14), (90.5, 14), (81, 12), (90, 12), (93, 2))
    assert found(spark, {"good": HEAD, "headless": headless}, IHS) == ["good"]


def test_cup_and_handle(spark):
    sharp = [*path(40, (100, 220)), *path(100, (75, 50), (100, 50), (94, 8), (97, 7), (101.5, 1), (102, 1))[1:]]
    assert found(spark, {"good": CUP_PATH, "sharp": sharp}, CUP, profile("tuned", min_reward_risk=None, cup_max_retrace=None)) == ["good"]


def test_flat_series_have_no_pivots(spark):
    p = ind.with_pivots(frame(spark, {"flat": [50.0] * 100}, wick=0.0))
    assert p.filter("piv_h or piv_l").count() == 0


def test_first_of_equal_highs_is_the_pivot(spark):
    close = [10.0] * 6 + [12.0, 12.0] + [10.0] * 8
    rows = [("s", None, i, c, c, c, c, 1.0) for i, c in enumerate(close)]
    b = spark.createDataFrame(rows, "symbol string, day date, idx int, open double, high double, low double, close double, volume double")
    assert [r.idx for r in ind.with_pivots(b).filter("piv_h").collect()] == [6]


def test_random_walks_are_mostly_not_patterns(spark):
    rng = np.random.default_rng(1)
    walks = {f"w{k}": (100 * np.exp(np.cumsum(rng.normal(0, 0.015, 300)))).tolist() for k in range(40)}
    rules = profile()
    e = ind.enrich(frame(spark, walks), rules)
    s = det.scan(e, rules, (DOUBLE, IHS, WOLFE), det.last_bars(e)).filter("status = 'CONFIRMED'")
    assert s.select("symbol").distinct().count() <= 4


def test_unknown_rules_raise():
    with pytest.raises(KeyError):
        profile("other")
    with pytest.raises(KeyError):
        profile("spec", no_such_rule=1)
    assert patterns("db, ihs") == (DOUBLE, IHS) and patterns(None) == PATTERNS


def test_smoothing_matches_a_loop_on_long_series(spark):
    rng = np.random.default_rng(2)
    close = (100 + np.cumsum(rng.normal(0, 1, 1500))).tolist()
    b = ind.smooth(frame(spark, {"s": close}), "y", F.col("close"), 2 / 13)
    got = [r.y for r in b.orderBy("idx").collect()]
    want, y = [], None
    for x in close:
        y = x if y is None else y * (1 - 2 / 13) + x * 2 / 13
        want.append(y)
    assert np.allclose(got, want, rtol=1e-12)


def test_one_day_scan_equals_the_replay_of_that_day(spark):
    """No look-ahead: scanning a cut series equals the as-of rows of the whole series."""
    rules = profile("tuned")
    whole = frame(spark, {"a": DOUBLE_BOTTOM, "b": HEAD})
    day = 268
    cols = ["symbol", "pattern", "status", "entry", "stop", "score"]
    replayed = det.scan(ind.enrich(whole, rules), rules, (DOUBLE, IHS)).filter(F.col("d") == day).select(cols).toPandas()
    cut = whole.filter(F.col("idx") <= day)
    alone = det.scan(ind.enrich(cut, rules), rules, (DOUBLE, IHS)).filter(F.col("d") == day).select(cols).toPandas()
    assert replayed.sort_values(cols).values.tolist() == alone.sort_values(cols).values.tolist()
