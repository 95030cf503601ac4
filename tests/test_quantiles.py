"""Quantiles by narrowing against sorting, for every way the passes can end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickwork.operators.quantiles import quantiles


@pytest.mark.parametrize("few,bins", [(100_000, 1024), (5, 4), (0, 16)])
def test_quantiles_equal_sorted_values(spark, few, bins):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=501).tolist(), "b": [7.0] * 40, "c": [1e300, -1e300, 1e-300, 0.0, 5e-324], "d": [2.5], None: rng.integers(0, 3, 100).astype(float).tolist(), "e": [float("inf"), 1.0, float("-inf"), 2.0, 3.0], "f": [None]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("d", float("nan"))]
    d = spark.createDataFrame(rows, "slice string, v double")
    got = {r.slice: (r.mid, r.low, r.twice) for r in quantiles(d, ("slice",), {"mid": (F.col("v"), 0.5), "low": (F.col("v"), 0.05), "twice": (F.col("v") * 2, 0.9)}, few, bins).collect()}
    assert set(got) == set(values)
    assert got["f"] == (None, None, None)
    for g, vs in values.items():
        if g != "f":
            want = [np.median(vs), *(np.quantile(np.array(vs) * k, p) for k, p in ((1, 0.05), (2, 0.9)))] if g != "e" else [2.0]
            assert np.allclose(got[g][: len(want)], want, rtol=1e-12), g


def test_one_group_and_no_rows(spark):
    d = spark.createDataFrame([(3.0,), (1.0,), (2.0,), (10.0,)], "v double")
    assert quantiles(d, (), {"m": (F.col("v"), 0.5)}).first().m == 2.5
    assert quantiles(d.limit(0), (), {"m": (F.col("v"), 0.5)}).first().m is None
