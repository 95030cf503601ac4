"""Building blocks of the DuckDB SQL that checks the queries: common table expressions by name."""

from __future__ import annotations

from wickwork.functions.rules import CUP, DOUBLE, IHS, WOLFE, max_age, profile

SPAN = 1 << 31

BARS = """
t AS (SELECT CAST(l_suppkey AS BIGINT) AS symbol, l_shipdate, l_quantity,
  CAST(SUM(CAST(2*l_quantity - 51 AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cs,
  ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq FROM lineitem),
p AS (SELECT symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS day, seq, l_quantity, GREATEST(10000 + 4*cs, 100) AS cents FROM t),
b AS (SELECT symbol, day, CAST(min_by(cents, seq) AS DOUBLE)/100 AS open, CAST(max(cents) AS DOUBLE)/100 AS high, CAST(min(cents) AS DOUBLE)/100 AS low,
  CAST(max_by(cents, seq) AS DOUBLE)/100 AS close, SUM(l_quantity) AS volume FROM p GROUP BY symbol, day),
bars AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY day) - 1 AS INT) AS idx FROM b)"""

INDEX = """
ix AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS day, CAST(SUM(CAST(round(o_totalprice*100) AS BIGINT)) % 401 AS BIGINT) - 200 AS step FROM orders GROUP BY 1),
index_bars AS (SELECT day, CAST(greatest(20000 + 2*SUM(step) OVER (ORDER BY day), 100) AS DOUBLE)/100 AS close, ROW_NUMBER() OVER (ORDER BY day) - 1 AS idx FROM ix)"""

VOL = """
vol_bars AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS day, CAST(4*SUM(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/COUNT(*) AS close FROM lineitem GROUP BY 1)"""

SNAPSHOTS = """
snapshots AS (SELECT make_date(y, 1, 1) AS snapshot_date, CAST(s_suppkey AS BIGINT) AS symbol FROM supplier, generate_series(1996, 2001) g(y) WHERE (s_suppkey*7 + y) % 10 <> 0)"""

RAW = """
raw AS (SELECT symbol, day, CASE WHEN n AND symbol % 11 = 0 THEN NULL ELSE open END AS open, CASE WHEN n AND symbol % 11 = 0 THEN NULL ELSE high END AS high,
  CASE WHEN n AND symbol % 11 = 0 THEN NULL ELSE low END AS low, CASE WHEN n AND (symbol % 11 = 0 OR symbol % 7 = 0) THEN NULL ELSE close END AS close, volume,
  CASE WHEN NOT n THEN close * (1 - 0.02*(symbol % 3)) END AS adj_close
  FROM (SELECT *, idx = max(idx) OVER (PARTITION BY symbol) AS n FROM bars))"""

QUOTES = """
quotes AS (SELECT symbol, max_by(close, idx) AS price, CASE WHEN symbol % 14 = 0 THEN max(day) - 1 ELSE max(day) END AS traded_day FROM bars WHERE symbol % 7 = 0 GROUP BY symbol)"""


def r(x: str, n: int) -> str:
    return f"(floor(({x})*1e{n} + 0.5)/1e{n})"


def mean(column: str, over: str) -> str:
    """The mean of a price from whole millionths."""
    return f"CAST(sum(CAST(round({column}*1e6) AS BIGINT)) {over} AS DOUBLE)/(count({column}) {over}*1e6)"


def enriched(rules: dict) -> str:
    s = "PARTITION BY symbol ORDER BY idx"
    w = lambda a, b: f"OVER ({s} ROWS BETWEEN {a} AND {b})"
    back = lambda n: w(f"{n} PRECEDING", "CURRENT ROW")
    vol = w(f"{rules['volume_len']} PRECEDING", "1 PRECEDING")
    before, after = w("5 PRECEDING", "1 PRECEDING"), w("1 FOLLOWING", "5 FOLLOWING")
    return f"""
e0 AS (SELECT *, lag(close) OVER ({s}) AS pc FROM bars),
e1 AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM e0),
e2 AS (SELECT *, {mean('tr', back(13))} AS atr, CASE WHEN idx >= 49 THEN {mean('close', back(49))} END AS sma50, CASE WHEN idx >= 199 THEN {mean('close', back(199))} END AS sma200,
  max(high) {back(60)} AS hi60, min(low) {back(rules['cup_prior_lookback'])} AS low_prior, min(low) {back(rules['cup_advance_lookback'])} AS low_advance,
  CASE WHEN idx >= 20 AND avg(volume) {vol} <> 0 THEN {r(f"volume / avg(volume) {vol}", 2)} END AS vr,
  CASE WHEN stddev_samp(volume) {vol} > 0 THEN {r(f"(volume - avg(volume) {vol}) / stddev_samp(volume) {vol}", 2)} END AS vz,
  count(*) {before} = 5 AND count(*) {after} = 5 AND high > max(high) {before} AND high >= max(high) {after} AS piv_h,
  count(*) {before} = 5 AND count(*) {after} = 5 AND low < min(low) {before} AND low <= min(low) {after} AS piv_l FROM e1),
e3 AS (SELECT *, lag(sma200, 39) OVER ({s}) AS s200_then FROM e2),
e AS (SELECT *, CASE WHEN sma200 IS NULL THEN coalesce(close > sma50, false) ELSE close > sma200 END AS uptrend,
  CASE WHEN sma200 IS NULL OR s200_then IS NULL THEN coalesce(close < 0.85*sma50, false) ELSE close < 0.9*sma200 AND sma200 < s200_then END AS strong_down,
  CASE WHEN sma200 IS NULL THEN 'close ' || CASE WHEN coalesce(close > sma50, false) THEN 'above' ELSE 'below' END || ' SMA50 (SMA200 n/a)'
    ELSE 'close ' || CASE WHEN close > sma200 THEN 'above' ELSE 'below' END || ' SMA200, SMA50 ' || CASE WHEN sma50 > sma200 THEN '>' ELSE '<' END || ' SMA200, ' ||
      CASE WHEN s200_then IS NULL THEN 'SMA200 slope n/a' WHEN sma200 < s200_then THEN 'SMA200 falling' ELSE 'SMA200 rising/flat' END END AS trend FROM e3)"""


def _lows() -> str:
    lead = ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for k in (1, 2) for c in ("idx", "low", "atr", "close"))
    return f"lows AS (SELECT symbol, idx, low, atr, close, hi60, {lead} FROM e WHERE piv_l WINDOW w AS (PARTITION BY symbol ORDER BY idx))"


def double_bottom(q: dict) -> str:
    return f"""
{_lows()},
db1 AS (SELECT symbol, idx AS l1, idx1 AS l2, low AS v1, low1 AS v2, atr1 AS unit, hi60, least(low, low1) AS lo, greatest(low, low1) AS hi FROM lows
  WHERE idx1 - idx BETWEEN {q['db_len'][0]} AND {q['db_len'][1]} AND abs(low - low1) <= {q['db_low_tol']}*least(low, low1)),
db2 AS (SELECT c.*, x.high AS peak, x.idx AS p FROM db1 c JOIN e x ON x.symbol = c.symbol AND x.idx > l1 AND x.idx < l2
  QUALIFY row_number() OVER (PARTITION BY c.symbol, l1 ORDER BY x.high DESC, x.idx) = 1),
db3 AS (SELECT *, (p - l1) / CAST(greatest(l2 - p, 1) AS DOUBLE) AS ratio FROM db2 WHERE unit > 0 AND peak - hi >= {q['db_min_depth_atr']}*unit AND peak >= hi*(1 + {q['db_min_rise']})),
cand_db AS (SELECT symbol, '{DOUBLE}' AS pattern, l1*{SPAN}::BIGINT + l2 AS cand, l2 + 5 AS known, 1073741824 AS until, l2 + 1 AS start, peak AS v0, 0 AS i0, 0.0::DOUBLE AS slope, v2 AS flr, l2 AS last,
  v2 AS last_low, unit AS last_atr, peak - lo AS height, NULL::DOUBLE AS target_at,
  50 + 15*(1 - least(abs(v1 - v2)/({q['db_low_tol']}*lo), 1.0)) + 10*(1 - abs(ln(ratio))/ln({q['db_time_sym']})) + 10*greatest(0.0, least((peak/hi - 1)/{q['db_min_rise']} - 1, 1.0)) AS score0,
  hi60 - v1 >= {q['db_prior_decline_of_height']}*(peak - lo) AS decline_ok, l1, p, l2, v1, peak, v2 FROM db3 WHERE ratio <= {q['db_time_sym']} AND ratio >= 1/{q['db_time_sym']})"""


def inverse_hs(q: dict, windowed: bool = False) -> str:
    """With ``windowed`` the depth of the head is left to the signals, which know where the window begins."""
    sym, share, fall, drop = q["ihs_shoulder_sym"], q["ihs_shoulder_sym_of_height"], q["ihs_prior_decline"], q["ihs_prior_decline_of_height"]
    shallow = "(least(lv, rv) - hv)"
    limit = f"{sym}*{shallow}" if sym is not None else f"{share or 0.0}*head"
    alike = " AND ".join(f"abs(lv - rv) <= {x}" for x in ([f"{sym}*{shallow}"] if sym is not None else []) + ([f"{share}*head"] if share is not None else [])) or "true"
    ok = " OR ".join(([f"(hi60 - lv)/hi60 >= {fall}"] if fall is not None else []) + ([f"hi60 - lv >= {drop}*head"] if drop is not None else [])) or "false"
    side = "true" if q["ihs_side_sym_tol"] is None else f"abs((n1 - ls) - (rs - n2)) / CAST(greatest(n1 - ls, rs - n2) AS DOUBLE) <= {q['ihs_side_sym_tol']}"
    return f"""
{_lows()},
ih1 AS (SELECT symbol, idx AS ls, idx1 AS h, idx2 AS rs, low AS lv, low1 AS hv, low2 AS rv, atr2 AS ra, close1 AS hc, hi60, (idx1 - idx) / CAST(greatest(idx2 - idx1, 1) AS DOUBLE) AS ratio FROM lows
  WHERE idx2 - idx BETWEEN {q['ihs_len'][0]} AND {q['ihs_len'][1]} AND {"low1 < low AND low1 < low2" if windowed else f"low1 < low - {q['ihs_min_head_atr']}*atr1 AND low1 < low2 - {q['ihs_min_head_atr']}*atr1"}),
ih2 AS (SELECT c.*, x.idx AS n1, x.high AS h1 FROM ih1 c JOIN e x ON x.symbol = c.symbol AND x.idx > ls AND x.idx < h QUALIFY row_number() OVER (PARTITION BY c.symbol, ls ORDER BY x.high DESC, x.idx) = 1),
ih3 AS (SELECT c.*, x.idx AS n2, x.high AS h2 FROM ih2 c JOIN e x ON x.symbol = c.symbol AND x.idx > h AND x.idx < rs QUALIFY row_number() OVER (PARTITION BY c.symbol, ls ORDER BY x.high DESC, x.idx) = 1),
ih4 AS (SELECT *, (h2 - h1)/(n2 - n1) AS slope FROM ih3 WHERE ratio <= {q['ihs_time_sym']} AND ratio >= 1/{q['ihs_time_sym']}),
ih5 AS (SELECT *, abs(slope*(rs - ls))/hc AS tilt, h1 + slope*(h - n1) - hv AS head FROM ih4),
cand_ihs AS (SELECT symbol, '{IHS}' AS pattern, ls*{SPAN}::BIGINT + rs AS cand, rs + 5 AS known, 1073741824 AS until, rs + 1 AS start, h1 AS v0, n1 AS i0, slope, rv AS flr, rs AS last, rv AS last_low, ra AS last_atr,
  {'head' if q['ihs_target_at_head'] else 'NULL::DOUBLE'} AS height, hv AS target_at, lv, hv, rv, ls, h, rs, head,
  50 + 15*(1 - least(abs(lv - rv)/greatest({limit}, 1e-9), 1.0)) + 10*(1 - abs(ln(ratio))/ln({q['ihs_time_sym']})) + 10*(1 - least(tilt/{q['ihs_max_neck_slope']}, 1.0)) AS score0,
  {ok} AS decline_ok
  FROM ih5 WHERE tilt <= {q['ihs_max_neck_slope']} AND {alike} AND {side})"""


def wolfe(q: dict) -> str:
    tol = q["ww_time_sym_tol"]
    legs = "true" if tol is None else " AND ".join(f"abs({leg} - (p4 - p1)/3.0::DOUBLE) <= {tol}*((p4 - p1)/3.0::DOUBLE)" for leg in ("(p2 - p1)", "(p3 - p2)", "(p4 - p3)"))
    return f"""
{_lows()},
ww1 AS (SELECT symbol, idx AS p1, idx1 AS p3, idx2 AS p5, low AS v1, low1 AS v3, low2 AS v5, atr2 AS a5 FROM lows WHERE idx2 - idx BETWEEN {q['ww_len'][0]} AND {q['ww_len'][1]} AND low1 < low AND low2 < low1),
ww2 AS (SELECT c.*, x.idx AS p2, x.high AS v2 FROM ww1 c JOIN e x ON x.symbol = c.symbol AND x.piv_h AND x.idx > p1 AND x.idx < p3 QUALIFY row_number() OVER (PARTITION BY c.symbol, p1 ORDER BY x.high DESC, x.idx) = 1),
ww3 AS (SELECT c.*, x.idx AS p4, x.high AS v4 FROM ww2 c JOIN e x ON x.symbol = c.symbol AND x.piv_h AND x.idx > p3 AND x.idx < p5 QUALIFY row_number() OVER (PARTITION BY c.symbol, p1 ORDER BY x.high DESC, x.idx) = 1),
ww4 AS (SELECT *, (v3 - v1)/(p3 - p1) AS s13, (v4 - v2)/(p4 - p2) AS s24 FROM ww3 WHERE v4 < v2 AND v1 < v4),
ww5 AS (SELECT *, v1 + s13*(p5 - p1) - v5 AS ov, (v2 - s24*p2 - (v1 - s13*p1))/(s13 - s24) AS eta FROM ww4 WHERE s24 < s13),
cand_ww AS (SELECT symbol, '{WOLFE}' AS pattern, p1*{SPAN}::BIGINT + p5 AS cand, p5 + 5 AS known, p5 + {q['ww_max_bars_since_p5']} AS until, p5 + 1 AS start, v1 AS v0, p1 AS i0, s13 AS slope, v5 AS flr, p5 AS last,
  v5 AS last_low, a5 AS last_atr, NULL::DOUBLE AS height, CASE WHEN eta > p5 AND eta <= p5 + {q['ww_max_eta_bars']} THEN v1 + (v4 - v1)/(p4 - p1)*(eta - p1) END AS target_at,
  50 + 15*(1 - least(abs(ov)/({q['ww_max_overshoot_atr']}*a5), 1.0)) + 10*(1 - least(abs(ln((p3 - p1)/CAST(greatest(p5 - p3, 1) AS DOUBLE)))/ln(3.0), 1.0)) AS score0, true AS decline_ok, p1, p2, p3, p4, p5, v1, v2, v3, v4, v5
  FROM ww5 WHERE {"ov >= 0 AND v5 >= v3 + s24*(p5 - p3)" if q['ww_sweet_zone'] else f"ov >= -0.5*a5 AND ov <= {q['ww_max_overshoot_atr']}*a5"} AND {legs})"""


def cup_pairs(q: dict) -> str:
    near = f"{q['cup_rim_tol']}*ra" if q["cup_rim_tol_of_depth"] is None else f"{q['cup_rim_tol_of_depth']}*(ra - bottom)"
    back = "true" if q["cup_max_retrace"] is None else f"ra - bottom <= {q['cup_max_retrace']}*(ra - low_advance)"
    return f"""
cu1 AS (SELECT x.symbol, x.idx AS a, y.idx AS b, x.high AS ra, y.high AS rb, x.low_prior, x.low_advance FROM e x JOIN e y ON x.symbol = y.symbol AND x.piv_h AND y.piv_h
  AND y.idx - x.idx BETWEEN {q['cup_len'][0]} AND {q['cup_len'][1]}),
cu2 AS (SELECT c.*, z.low AS bottom, z.idx AS bi FROM cu1 c JOIN e z ON z.symbol = c.symbol AND z.idx BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY c.symbol, a, b ORDER BY z.low, z.idx) = 1),
cu3 AS (SELECT *, (ra - bottom)/ra AS depth, (bi - a)/CAST(b - a AS DOUBLE) AS pos FROM cu2),
cup_pairs AS (SELECT * FROM cu3 WHERE depth BETWEEN {q['cup_depth'][0]} AND {q['cup_depth'][1]} AND abs(rb - ra) <= {near}
  AND pos BETWEEN {q['cup_bottom_zone'][0]} AND {q['cup_bottom_zone'][1]} AND {back})"""


def cup_fits() -> str:
    # The parabola's R2 from orthogonal parts written out as sums; the V's from the squared correlation.
    return """
cf1 AS (SELECT c.symbol, a, b, bi, z.low AS y, z.idx - a - (b - a)/2.0::DOUBLE AS t, z.idx - a AS x, (b - a + 1) AS m FROM cup_pairs c JOIN e z ON z.symbol = c.symbol AND z.idx BETWEEN a AND b),
cf2 AS (SELECT *, t*t - (m*m - 1)/12.0::DOUBLE AS q FROM cf1),
fit_u AS (SELECT symbol, a, b, bi, max(m) AS m, CASE WHEN var_pop(y) > 0 AND covar_pop(y, q) > 0 THEN power(corr(y, t), 2) + power(corr(y, q), 2) ELSE 0.0 END AS u FROM cf2 GROUP BY symbol, a, b, bi),
cv1 AS (SELECT f.*, g.c FROM fit_u f, generate_series(1, 300) g(c) WHERE g.c BETWEEN greatest(1, bi - a - greatest(3, m // 10)) AND least(m - 2, bi - a + greatest(3, m // 10))),
cv2 AS (SELECT v.symbol, v.a, v.b, v.c, CASE WHEN covar_pop(y, abs(x - c)) > 0 THEN power(corr(y, abs(x - c)), 2) ELSE 0.0 END AS v FROM cv1 v JOIN cf2 w ON v.symbol = w.symbol AND v.a = w.a AND v.b = w.b GROUP BY v.symbol, v.a, v.b, v.c),
fit_v AS (SELECT symbol, a, b, max(v) AS v FROM cv2 GROUP BY symbol, a, b)"""


def cup_handle(q: dict) -> str:
    least_, most = q["handle_len"]
    share = q["handle_max_len_of_cup"]
    m = f"{most}" if share is None else f"least({most}, CAST(floor((c.b - c.a)*{share}) AS INT))"
    return f"""
{cup_pairs(q)},
{cup_fits()},
cu5 AS (SELECT c.*, u FROM cup_pairs c JOIN fit_u f USING (symbol, a, b) JOIN fit_v v USING (symbol, a, b) WHERE u >= {q['cup_min_roundness']} AND v - u <= {q['cup_max_v_advantage']}),
hb AS (SELECT c.symbol, c.a, c.b, z.idx AS j, z.close, max(z.high) OVER w AS hh, min(z.low) OVER w AS hl, max(z.high) OVER w2 AS before, {m} AS m FROM cu5 c JOIN e z ON z.symbol = c.symbol AND z.idx > b AND z.idx <= b + {m}
  WINDOW w AS (PARTITION BY c.symbol, c.a, c.b ORDER BY z.idx), w2 AS (PARTITION BY c.symbol, c.a, c.b ORDER BY z.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hj AS (SELECT symbol, a, b, min(j) AS jj FROM hb WHERE j >= b + {least_ + 1} AND close > before GROUP BY symbol, a, b),
hv AS (SELECT hb.*, jj, coalesce(jj - 1, b + m) AS final_end FROM hb LEFT JOIN hj USING (symbol, a, b) WHERE j >= b + {least_} AND j <= coalesce(jj - 1, b + m)),
hl AS (SELECT hv.*, z.idx AS hi_, z.atr AS ha FROM hv JOIN e z ON z.symbol = hv.symbol AND z.idx > hv.b AND z.idx <= hv.j AND z.low = hv.hl QUALIFY row_number() OVER (PARTITION BY hv.symbol, hv.a, hv.b, hv.j ORDER BY z.idx) = 1),
cand_cup AS (SELECT c.symbol, '{CUP}' AS pattern, c.a*{SPAN}::BIGINT + c.b AS cand, h.j AS known, CASE WHEN h.j = final_end THEN 1073741824 ELSE h.j END AS until, h.j + 1 AS start, h.hh AS v0, 0 AS i0, 0.0::DOUBLE AS slope, NULL::DOUBLE AS flr,
  h.hi_ AS last, h.hl AS last_low, h.ha AS last_atr, {'c.ra' if q['cup_target_base'] == 'left_rim' else 'c.rb'} - c.bottom AS height, c.bottom AS target_at,
  50 + 15*(u - {q['cup_min_roundness']})/(1 - {q['cup_min_roundness']}) + 10*(1 - least(abs(depth - 0.25)/0.25, 1.0)) + 10*(1 - least((c.rb - h.hl)/c.rb/{q['handle_max_depth']}, 1.0)) AS score0,
  (c.ra - low_prior)/low_prior >= {q['cup_prior_advance']} AS decline_ok, c.ra, c.bottom, c.a, c.b, c.bi, h.hi_, c.rb, h.hl
  FROM cu5 c JOIN hl h ON c.symbol = h.symbol AND c.a = h.a AND c.b = h.b
  WHERE (c.rb - h.hl)/c.rb <= {q['handle_max_depth']} AND h.hl >= c.bottom + 0.5*(c.rb - c.bottom) AND (c.rb - h.hl)/c.rb <= {q['handle_fraction_of_cup']}*depth)"""


CANDIDATES = {CUP: (cup_handle, "cand_cup"), IHS: (inverse_hs, "cand_ihs"), DOUBLE: (double_bottom, "cand_db"), WOLFE: (wolfe, "cand_ww")}
SIGNAL = "symbol, d, day, pattern, status, entry, stop, risk_pct, target, score, last_close, bars_since_break, volume_ratio, trend, max_buy, reward_risk"


def signals(q: dict, pattern: str, name: str, days: str = "true", bars: int | None = None) -> str:
    """Signals as of every bar d that ``days`` allows, judged for each candidate and bar on its own."""
    cand = CANDIDATES[pattern][1]
    trend = {CUP: "s.sma50 > s.sma200", WOLFE: "false"}.get(pattern, "s.sma50 < s.sma200")
    trend = trend if {CUP: q["cup_sma_or"], IHS: q["ihs_sma_or"], DOUBLE: q["db_sma_or"], WOLFE: True}[pattern] else "false"
    veto = ("s.uptrend" if q["cup_above_sma200"] else "true") if pattern == CUP else ("NOT s.strong_down" if q["veto_reversals"] else "true")
    volume = q["volume_confirm"][pattern]
    loud = "true" if volume is None else f"coalesce(fb_vr >= {volume}, false)"
    wait = "true" if q["max_wait_bars"] is None else f"(conf OR d - last <= {q['max_wait_bars']})"
    target = (f"CASE WHEN target_at <= close*(1 + {q['ww_max_target_gain']}) AND target_at > entry THEN target_at END" if pattern == WOLFE else "entry + coalesce(height, tr_ - target_at)")
    reward = "true" if q["min_reward_risk"] is None else f"(rr IS NULL OR rr >= {q['min_reward_risk']})"
    limit, weight = q["max_risk_pct"][pattern], 10 if pattern in (CUP, WOLFE) else 5
    up = "0.0" if pattern == CUP else "CASE WHEN uptrend THEN 5.0 ELSE 0.0 END"
    cap = f"tr_*(1 + {q['max_runaway']})"
    if q["max_buy_risk_mult"] is not None:
        cap = f"least({cap}, stop_ + {q['max_buy_risk_mult']}*(entry - stop_))"
    columns, seen = "c.*", "true"
    if bars is not None:
        days += f" AND cand // {SPAN} >= x.idx - {bars} + 6"
        low, high = (lambda n: f"(SELECT min(z.low) FROM e z WHERE z.symbol = c.symbol AND z.idx BETWEEN greatest(c.cand // {SPAN} - {n}, x.idx - {bars} + 1) AND c.cand // {SPAN})"), f"(SELECT max(z.high) FROM e z WHERE z.symbol = c.symbol AND z.idx BETWEEN greatest(c.cand // {SPAN} - 60, x.idx - {bars} + 1) AND c.cand // {SPAN})"
        if pattern == DOUBLE:
            columns = f"c.* EXCLUDE (decline_ok), {high} - (SELECT z.low FROM e z WHERE z.symbol = c.symbol AND z.idx = c.cand // {SPAN}) >= {q['db_prior_decline_of_height']}*c.height AS decline_ok"
        if pattern == IHS:
            columns = f"c.* EXCLUDE (decline_ok), {high} - c.lv >= {q['ihs_prior_decline_of_height']}*c.head AS decline_ok"
            unit = f"(SELECT CAST(sum(CAST(round((CASE WHEN z.idx = greatest(x.idx - {bars} + 1, 0) THEN z.high - z.low ELSE z.tr END)*1e6) AS BIGINT)) AS DOUBLE)/(count(*)*1e6) FROM e z WHERE z.symbol = c.symbol AND z.idx BETWEEN greatest(x.idx - {bars} + 1, c.h - 13) AND c.h)"
            seen = f"c.hv < c.lv - {q['ihs_min_head_atr']}*{unit} AND c.hv < c.rv - {q['ihs_min_head_atr']}*{unit}"
        if pattern == CUP:
            columns = f"c.* EXCLUDE (decline_ok), (c.ra - {low(q['cup_prior_lookback'])})/{low(q['cup_prior_lookback'])} >= {q['cup_prior_advance']} AS decline_ok"
            seen = f"c.ra - c.bottom <= {q['cup_max_retrace']}*(c.ra - {low(q['cup_advance_lookback'])})"
    return f"""
{name}1 AS (SELECT {columns}, x.idx AS d, x.day, x.close, x.sma50, x.sma200, x.uptrend, x.strong_down, x.trend, v0 + slope*(x.idx - i0) AS now_ FROM {cand} c JOIN e x ON x.symbol = c.symbol AND x.idx >= greatest(known, 59) AND x.idx <= until AND {days} WHERE {seen}),
{name}2 AS (SELECT s.symbol, s.cand, s.start, s.d, min(y.idx) AS fb FROM {name}1 s JOIN e y ON y.symbol = s.symbol AND y.idx >= s.start AND y.idx <= s.d AND y.close > v0 + slope*(y.idx - i0) WHERE s.close > now_ GROUP BY 1, 2, 3, 4),
{name}3 AS (SELECT s.*, f.fb, y.vr AS fb_vr, v0 + slope*(f.fb - i0) AS at_ FROM {name}1 s LEFT JOIN {name}2 f ON s.symbol = f.symbol AND s.cand = f.cand AND s.start = f.start AND s.d = f.d LEFT JOIN e y ON y.symbol = s.symbol AND y.idx = f.fb
  WHERE (decline_ok OR coalesce({trend}, false)) AND {veto}),
{name}4 AS (SELECT *, close > now_ AND {loud} AS conf FROM {name}3 WHERE CASE WHEN close > now_ THEN d - fb <= {max_age(q, pattern)} AND close <= at_*(1 + {q['max_runaway']})
  ELSE close >= now_*(1 - {q['watch_proximity']}) AND (flr IS NULL OR close > flr) END),
{name}5 AS (SELECT *, CASE WHEN conf THEN at_ ELSE now_ END AS tr_, CASE WHEN conf AND close > at_ THEN close WHEN conf THEN at_ ELSE now_ END AS entry, last_low - 0.25*last_atr AS stop_ FROM {name}4),
{name}6 AS (SELECT *, (entry - stop_)/entry*100 AS risk, {target} AS tg FROM {name}5 WHERE stop_ < entry),
{name}7 AS (SELECT *, CASE WHEN tg IS NOT NULL THEN {r("(tg - entry)/(entry - stop_)", 2)} END AS rr FROM {name}6 WHERE risk <= {limit} AND {wait}),
{name}8 AS (SELECT *, CAST(greatest(0, least(100, round_even({r(f"score0 + {weight}*(1 - least(risk/{limit}, 1.0)) + CASE WHEN close > now_ AND coalesce(fb_vr >= 1.3, false) THEN 5.0 ELSE 0.0 END + {up}", 6)}, 0))) AS INT) AS score FROM {name}7 WHERE {reward}),
{name} AS (SELECT symbol, d, day, pattern, CASE WHEN conf THEN 'CONFIRMED' ELSE 'WATCHLIST' END AS status, {r("entry", 2)} AS entry, {r("stop_", 2)} AS stop, {r("risk", 2)} AS risk_pct, {r("tg", 2)} AS target, score, close AS last_close,
  CASE WHEN conf THEN CAST(d - fb AS INT) END AS bars_since_break, CASE WHEN close > now_ THEN fb_vr END AS volume_ratio, trend, {r(cap, 2)} AS max_buy, rr AS reward_risk, cand, last, {r("tr_", 2)} AS trigger
  FROM {name}8 WHERE score >= {q['min_score']} QUALIFY row_number() OVER (PARTITION BY symbol, d, pattern, CASE WHEN conf THEN 1 ELSE 2 END ORDER BY score DESC, cand) = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p for p in parts if p) + "\n"


def detector(pattern: str, profile_name: str = "spec", name: str = "sig", days: str = "true", **overrides) -> tuple[str, str, str]:
    q = profile(profile_name, **overrides)
    return enriched(q), CANDIDATES[pattern][0](q), signals(q, pattern, name, days)


def scan_all(profile_name: str = "spec", days: str = "true", **overrides) -> str:
    """``allsig``: the signals of all four patterns."""
    q = profile(profile_name, **overrides)
    parts, names, seen = [enriched(q)], [], False
    for i, pattern in enumerate(CANDIDATES):
        text = CANDIDATES[pattern][0](q)
        if _lows() in text:
            text = text if not seen else text.replace(f"\n{_lows()},", "")
            seen = True
        parts += [text, signals(q, pattern, f"s{i}_", days)]
        names.append(f"SELECT * FROM s{i}_")
    return ",".join(parts) + ",\nallsig AS (" + " UNION ALL ".join(names) + ")"
