"""Many rules at once, windows of bars, and first passages against plain ways of getting the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_patterns import CUP_PATH, DOUBLE_BOTTOM, HEAD, frame
from wickwork.functions import indicators as ind
from wickwork.functions.rules import CUP, DOUBLE, IHS, LEGACY, PATTERNS, SPEC, WOLFE, Fixed, flat, override, profile
from wickwork.operators import detectors as det
from wickwork.sources.bars import bars as table_bars

COLUMNS = ["symbol", "d", "pattern", "status", "entry", "stop", "target", "score", "max_buy"]


def walks(n, length, seed, step=0.03):
    rng = np.random.default_rng(seed)
    return {f"w{k}": (60 * np.exp(np.cumsum(rng.normal(0, step, length)))).tolist() for k in range(n)}


def rows(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("pattern", PATTERNS)
def test_variants_equal_scans_of_their_own(spark, pattern):
    """Every legacy rule that the pattern reads, in one scan, against a scan with that rule alone."""
    series = walks(40 if pattern == WOLFE else 6, 420, 5) | {"db": DOUBLE_BOTTOM, "ihs": HEAD, "cup": CUP_PATH}
    loose = {"min_score": 0, "min_reward_risk": None, "volume_confirm": dict.fromkeys(PATTERNS), "watch_proximity": 0.2}
    base = SPEC | loose
    keys = [k for k in LEGACY if flat(base | {k: LEGACY[k]}, pattern) != flat(base, pattern)]
    variants = [base] + [base | {k: LEGACY[k]} for k in keys]
    bars = frame(spark, series)
    e = ind.enrich_for(bars, variants)
    got = det.scan_variants(e, {i: flat(v, pattern) for i, v in enumerate(variants)}, pattern, det.summaries(e)).toPandas()
    assert len(got)
    for i in sorted({0, len(variants) - 1, len(variants) // 2}):
        alone = rows(det.scan(ind.enrich(bars, variants[i]), variants[i], (pattern,)))
        assert sorted(map(tuple, got[got.variant == i][COLUMNS].astype(object).where(lambda x: x.notna(), None).values.tolist())) == alone, (i, keys)


def test_window_equals_the_scan_of_a_cut_series(spark):
    """What a scan of the last 240 bars reports, against scanning a series that has only those bars."""
    series = walks(40, 330, 11)
    rules = profile("spec", min_score=0, cup_prior_advance=0.05, watch_proximity=0.2)
    whole = frame(spark, series)
    days = list(range(242, 330, 6))
    e = ind.enrich(whole, rules)
    windowed = det.scan(e, rules, bars=240).filter(F.col("d").isin(days))
    got = sorted(tuple(r) for r in windowed.select(COLUMNS).collect())
    # Each cut series is a symbol of its own, looked at on its last bar.
    day = F.explode(F.array(*map(F.lit, days)))
    cut = whole.select("*", day.alias("day_")).filter(F.col("idx").between(F.col("day_") - 239, F.col("day_"))).withColumn("idx", F.col("idx") - F.col("day_") + 239)
    cut = ind.enrich(cut.withColumn("symbol", F.concat_ws("@", "symbol", "day_")), rules)
    want = [(r.symbol.split("@")[0], int(r.symbol.split("@")[1]), *r[2:]) for r in det.scan(cut, rules, days=det.last_bars(cut)).select(COLUMNS).collect()]
    assert got == sorted(want) and len({r[2] for r in got}) >= 3 and len(got) > 40
    with pytest.raises(ValueError):
        det.scan(ind.enrich(whole, rules), rules, (CUP,), bars=200)


def test_first_passage_equals_a_search_and_reads_few_blocks(spark, tiny):
    e = ind.enrich(table_bars(spark, tiny), profile())
    lines = e.filter("idx % 7 = 3").select("symbol", (F.col("idx") * 1).alias("cand"), (F.col("idx") + 1).alias("start"), (F.col("close") * 1.08).alias("v0"), (F.lit(0.02) * (F.col("idx") % 5 - 2)).alias("slope"), F.col("idx").alias("i0"))
    got = {(r.symbol, r.cand): r.fb for r in det.breakouts(lines, e).collect()}
    closes = {}
    for r in e.select("symbol", "idx", "close").orderBy("symbol", "idx").collect():
        closes.setdefault(r.symbol, []).append(r.close)
    for r in lines.collect():
        want = next((j for j in range(r.start, len(closes[r.symbol])) if closes[r.symbol][j] > r.v0 + r.slope * (j - r.i0)), None)
        assert got[r.symbol, r.cand] == want
    read = lines.join(det.summaries(e), "symbol").select(F.avg(F.size(det.passage_blocks())).alias("read"), F.avg(F.size("blocks")).alias("all")).first()
    assert read.read < read.all / 2


def test_extremes_of_any_stretch(spark, tiny):
    e = ind.enrich(table_bars(spark, tiny), profile()).filter("symbol < 4")
    asked = e.filter("idx >= 130").withColumn("low_", F.col("idx") - F.col("idx") % 130)
    got = det.looked_up(asked.select("symbol", "idx", "low_"), det.extremes(e, 256), F.col("low_"), F.col("idx"), "x").collect()
    bars = {(r.symbol, r.idx): r for r in e.collect()}
    assert len(got) == asked.count()
    for r in got[::17]:
        span = [bars[r.symbol, j] for j in range(r.low_, r.idx + 1)]
        assert (r.x_hi, r.x_lo) == (max(b.high for b in span), min(b.low for b in span))


def test_overrides():
    assert override("min_score=70") == ("min_score", 70) and override(" cup_depth = (0.1, 0.4) ") == ("cup_depth", (0.1, 0.4))
    assert override("min_reward_risk=None") == ("min_reward_risk", None) and override("cup_trigger=rim_b") == ("cup_trigger", "rim_b")
    assert override("max_wait_bars=30") == ("max_wait_bars", 30) and profile("spec", **dict([override("db_min_rise=0.2")]))["db_min_rise"] == 0.2
    for text in ("min_score", "no_such_rule=1", "cup_depth=0.4", "cup_depth=(1, 2, 3)", "veto_reversals=7", "min_score=high", "cup_trigger=5"):
        with pytest.raises(ValueError):
            override(text)


def test_rules_as_columns_have_types():
    q = Fixed(profile("tuned"), WOLFE)
    assert q.flat["max_wait_bars"] == 60 and "cup_len_lo" not in q.flat and "cup_len_lo" in Fixed(profile(), CUP).flat
    assert {flat(profile(), p)["max_age"] for p in (CUP, IHS, DOUBLE)} == {3, 8}
