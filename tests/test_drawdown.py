"""The deepest fall of a curve, from one pass over the positions."""

import datetime
import random

import __spark_entry__ as entry
from wickwork.operators import outcomes


def test_positions_are_searched_once(spark, tiny):
    # A path is searched for its stop and for its target. A condition on r, or a second reader, would repeat both searches.
    plan = entry.queries()["max_drawdown"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(transform(") == 2


def test_fall_by_days_is_the_fall_of_the_curve(spark):
    random.seed(4)
    start = datetime.date(2001, 1, 1)
    rows = [(g, start + datetime.timedelta(random.randrange(30)), n, random.choice([None, round(random.gauss(0.1, 1), 3)])) for g in "ab" for n in range(400)]
    rows += [("up", start + datetime.timedelta(n), n, 1.0 if n else None) for n in range(9)] + [("down", start, n, -1.0) for n in range(3)] + [("none", start, 1, None)]
    want = {}
    for g, _, _, x in sorted(rows, key=lambda t: t[:3]):
        if x is not None:
            cum, peak, deepest = want.get(g, (0.0, 0.0, 0.0))
            cum += x
            peak = max(peak, cum)
            want[g] = (cum, peak, min(deepest, cum - peak))
    d = spark.createDataFrame(rows, "g string, day date, n int, r double")
    got = {x.g: x.max_dd for x in outcomes.drawdown(d, ("g",), "day", ("n",)).collect()}
    assert set(got) == {"a", "b", "up", "down"} and got["up"] == 0 and got["down"] == -3
    assert all(abs(got[g] - want[g][2]) < 1e-3 for g in got)
