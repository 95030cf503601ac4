"""Rule profiles as data. A value of None turns a rule off."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUP, IHS, WOLFE, DOUBLE = "Cup & Handle", "Inverse Head & Shoulders", "Bullish Wolfe Wave", "Double Bottom"
PATTERNS = (CUP, IHS, DOUBLE, WOLFE)
ALIASES = {"cup": CUP, "ihs": IHS, "wolfe": WOLFE, "db": DOUBLE}

# The published constants of the base profile.
SPEC = {
    "pivot_order": 5, "atr_len": 14, "min_score": 60, "max_breakout_age": 3, "max_runaway": 0.05, "watch_proximity": 0.05,
    "strong_down": 0.90, "strong_down_sma50": 0.85, "slope_lookback": 40,
    "age_lag": {CUP: 0, IHS: 5, WOLFE: 5, DOUBLE: 5},
    "cup_len": (20, 300), "cup_depth": (0.12, 0.50), "cup_max_retrace": 0.50, "cup_advance_lookback": 250,
    "cup_rim_tol": 0.05, "cup_rim_tol_of_depth": 0.15, "cup_bottom_zone": (0.25, 0.75),
    "handle_len": (5, 25), "handle_max_len_of_cup": 1.0, "handle_max_depth": 0.12, "handle_fraction_of_cup": 0.50,
    "cup_prior_advance": 0.20, "cup_prior_lookback": 60, "cup_sma_or": True, "cup_above_sma200": False,
    "cup_min_roundness": 0.70, "cup_max_v_advantage": 0.0, "cup_target_base": "right_rim", "cup_trigger": "handle_high",
    "ihs_len": (20, 200), "ihs_min_head_atr": 1.0, "ihs_shoulder_sym": None, "ihs_shoulder_sym_of_height": 0.30,
    "ihs_time_sym": 2.5, "ihs_side_sym_tol": 0.40, "ihs_max_neck_slope": 0.15, "ihs_prior_decline": None,
    "ihs_prior_decline_of_height": 1.0, "ihs_sma_or": True, "ihs_target_at_head": True, "veto_reversals": False,
    "db_len": (15, 150), "db_low_tol": 0.03, "db_min_depth_atr": 2.0, "db_min_rise": 0.10, "db_time_sym": 3.0,
    "db_prior_decline_of_height": 1.0, "db_sma_or": True,
    "ww_len": (15, 200), "ww_sweet_zone": True, "ww_max_overshoot_atr": 2.0, "ww_time_sym_tol": 0.30,
    "ww_max_bars_since_p5": 25, "ww_max_eta_bars": 250, "ww_max_target_gain": 1.0,
    "volume_len": 20, "volume_confirm": {CUP: 1.4, IHS: 1.3, WOLFE: None, DOUBLE: 1.3},
    "max_risk_pct": {CUP: 12.0, IHS: 15.0, WOLFE: 15.0, DOUBLE: 15.0},
    "min_reward_risk": None, "max_wait_bars": None, "max_buy_risk_mult": 1.5,
    "max_listed_days": {CUP: 6, IHS: 6, WOLFE: 5, DOUBLE: 6}, "watch_only": (CUP,),
}
_NO_VOLUME = {CUP: None, IHS: None, WOLFE: None, DOUBLE: None}
# What the other profiles change.
TUNED = {
    "cup_max_retrace": 0.618, "ihs_side_sym_tol": None, "ww_time_sym_tol": 0.45, "volume_confirm": _NO_VOLUME,
    "min_reward_risk": 1.0, "max_wait_bars": 60,
}
LEGACY = {
    "cup_len": (30, 250), "cup_max_retrace": None, "cup_rim_tol": 0.05, "cup_rim_tol_of_depth": None,
    "cup_bottom_zone": (0.20, 0.80), "handle_len": (5, 40), "handle_max_len_of_cup": None, "cup_prior_advance": 0.25,
    "cup_prior_lookback": 120, "cup_sma_or": False, "cup_above_sma200": True, "cup_min_roundness": 0.60,
    "cup_target_base": "left_rim", "ihs_shoulder_sym": 0.50, "ihs_shoulder_sym_of_height": None, "ihs_side_sym_tol": None,
    "ihs_prior_decline": 0.10, "ihs_prior_decline_of_height": None, "ihs_sma_or": False, "ihs_target_at_head": False,
    "veto_reversals": True, "ww_sweet_zone": False, "ww_time_sym_tol": None, "volume_len": 50, "volume_confirm": _NO_VOLUME,
    "max_risk_pct": {CUP: 15.0, IHS: 15.0, WOLFE: 15.0, DOUBLE: 15.0}, "max_buy_risk_mult": None,
    "max_listed_days": {CUP: None, IHS: None, WOLFE: None, DOUBLE: None}, "watch_only": (),
}
PROFILES = {"spec": {}, "tuned": TUNED, "legacy": LEGACY}


def profile(name: str = "spec", **overrides) -> dict:
    """The rules of a profile with single rules replaced; an unknown name or rule raises."""
    if name not in PROFILES:
        raise KeyError(f"unknown profile {name}")
    for key in overrides:
        if key not in SPEC:
            raise KeyError(f"unknown rule {key}")
    return SPEC | PROFILES[name] | overrides


def _kind(values: list) -> str:
    known = [v for v in values if v is not None]
    if all(isinstance(v, bool) for v in known) and known:
        return "boolean"
    if all(isinstance(v, int) for v in known) and known:
        return "int"
    return "string" if known and all(isinstance(v, str) for v in known) else "double"


def kinds() -> dict[str, str]:
    """The type of each flat rule, over all profiles and patterns."""
    every = [flat(profile(name), p) for name in PROFILES for p in PATTERNS]
    return {key: _kind([f[key] for f in every if key in f]) for key in dict.fromkeys(k for f in every for k in f)}


def rules_table(spark: SparkSession, variants: dict[int, dict]) -> DataFrame:
    """(variant, rule): flat rules as data, one row a variant and one field a rule, null where a rule is off."""
    types = {k: t for k, t in kinds().items() if k in next(iter(variants.values()))}
    cast = lambda k, v: None if v is None else {"int": int, "double": float}.get(types[k], lambda x: x)(v)
    fields = ", ".join(f"{k}: {t}" for k, t in types.items())
    return spark.createDataFrame([(n, tuple(cast(k, f[k]) for k in types)) for n, f in variants.items()], f"variant int, rule struct<{fields}>")


class Fixed:
    """The rules of one profile as literals. With ``windowed`` a candidate is judged by what a part of the series shows."""

    def __init__(self, rules: dict, pattern: str, windowed: bool = False):
        self.flat, self.types, self.windowed = flat(rules, pattern), kinds(), windowed

    def __call__(self, key: str) -> Column:
        return F.lit(self.flat[key]).cast(self.types[key])

    def loosest(self, key: str, least: bool):
        return self.flat[key]

    def panel(self, column: str, key: str) -> Column:
        """A column of the enriched bars that was made with this rule."""
        return F.col(column)


class Joined:
    """The rules of many variants as fields of a joined column ``rule``; ``loosest`` is what any of them lets through."""

    windowed = False

    def __init__(self, variants: dict[int, dict]):
        self.variants = variants

    def __call__(self, key: str) -> Column:
        return F.col(f"rule.{key}")

    def loosest(self, key: str, least: bool):
        values = [f[key] for f in self.variants.values()]
        return None if None in values else (min if least else max)(values)

    def panel(self, column: str, key: str) -> Column:
        made = sorted({f[key] for f in self.variants.values()})
        return F.coalesce(*[F.when(self(key) == n, F.col(f"{column}_{n}")) for n in made])


def patterns(names: str | None) -> tuple[str, ...]:
    """Patterns by alias or full name, comma separated; all of them for None."""
    if not names:
        return PATTERNS
    return tuple(ALIASES.get(n.strip().lower(), n.strip()) for n in names.split(","))


#: Whose rules begin with what.
OWNERS = {"cup": CUP, "handle": CUP, "ihs": IHS, "db": DOUBLE, "ww": WOLFE}


def reads(pattern: str, key: str) -> bool:
    """Whether the scan of a pattern reads a rule; two of them are read by the nightly list only."""
    return OWNERS.get(key.split("_")[0], pattern) == pattern and key not in ("max_listed_days", "watch_only") and not (key == "veto_reversals" and pattern == CUP)


def flat(rules: dict, pattern: str) -> dict:
    """The rules that a pattern's scan reads, one value a name: spans as _lo and _hi, values per pattern as the pattern's own."""
    out = {}
    for key, value in rules.items():
        if not reads(pattern, key):
            continue
        if isinstance(value, tuple):
            out |= {f"{key}_lo": value[0], f"{key}_hi": value[1]}
        else:
            out[key] = value.get(pattern) if isinstance(value, dict) else value
    return out | {"max_age": max_age(rules, pattern)}


def max_age(rules: dict, pattern: str) -> int:
    return rules["max_breakout_age"] + rules["age_lag"].get(pattern, 0)


def override(text: str) -> tuple[str, object]:
    """A rule and its value from ``KEY=VALUE``: a literal where it is one, else text. An unknown rule, a text without ``=``
    and a value of another type than the rule's raise ValueError; None turns a rule off."""
    key, equals, raw = (x.strip() for x in text.partition("="))
    if not equals:
        raise ValueError(f"expected KEY=VALUE, got {text!r}")
    if key not in SPEC:
        raise ValueError(f"unknown rule {key!r}")
    try:
        value = ast.literal_eval(raw)
    except (ValueError, SyntaxError):
        value = raw
    known = [v for v in (SPEC[key], TUNED.get(key), LEGACY.get(key)) if v is not None]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    alike = lambda a, b: number(a) and number(b) or type(a) is type(b) and (not isinstance(a, tuple) or key == "watch_only" or len(a) == len(b))
    if value is not None and not any(alike(value, v) for v in known):
        raise ValueError(f"{key} takes a value like {known[0]!r}, not {value!r}")
    return key, value
