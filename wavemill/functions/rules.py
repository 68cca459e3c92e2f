"""Rule sets over a wave array: a boolean column per condition. A null condition is a failed one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .waves import WAVE

Rules = dict[str, Column]


def numbered(waves: Column | list[Column], n: int) -> list[Column]:
    return [waves[i] for i in range(n)]


def motive(w: list[Column]) -> Rules:
    """What impulses in either direction share: lengths and durations."""
    w1, w2, w3, w4, w5 = w
    return {
        "w2_retraces_a_fifth": w2["length"] >= 0.2 * w1["length"],
        "w2_lasts_a_ninth": 9 * w2["duration"] > w1["duration"],
        "w3_not_shortest": ~((w3["length"] < w5["length"]) & (w3["length"] < w1["length"])),
        "w3_at_least_third_of_w1": w3["length"] >= w1["length"] / 3,
        "w3_longer_than_w2": w3["length"] > w2["length"],
        "w3_lasts_a_seventh": 7 * w3["duration"] > w1["duration"],
        "w4_over_third_of_w2": w4["length"] > w2["length"] / 3,
        "w5_under_twice_w1": w5["length"] < 2 * w1["length"],
    }


def impulse(waves: Column) -> Rules:
    w1, w2, w3, w4, w5 = w = numbered(waves, 5)
    return motive(w) | {"w2_above_start": w2["low"] > w1["low"], "w3_over_w1": w3["high"] > w1["high"], "w4_above_w1": w4["low"] > w1["high"], "w5_over_w3": w5["high"] > w3["high"]}


def bearish_impulse(waves: Column) -> Rules:
    w1, w2, w3, w4, w5 = w = numbered(waves, 5)
    return motive(w) | {"w2_below_start": w2["high"] < w1["high"], "w3_under_w1": w3["low"] < w1["low"], "w4_below_w1": w4["high"] < w1["low"], "w5_under_w3": w5["low"] < w3["low"]}


def correction(waves: Column) -> Rules:
    a, b, c = numbered(waves, 3)
    return {
        "b_below_start": a["high"] > b["high"], "c_below_a": a["low"] > c["low"], "a_longer_than_b": a["length"] > b["length"], "b_lasts_under_ten_a": b["duration"] < 10 * a["duration"],
        "c_over_0.6_a": 0.6 * a["length"] < c["length"], "c_under_2.61_a": c["length"] < 2.61 * a["length"],
        "b_over_0.35_a": 0.35 * a["length"] < b["length"], "b_under_0.618_a": b["length"] < 0.618 * a["length"], "c_lasts_under_ten_a": c["duration"] < 10 * a["duration"],
    }


def td_wave(waves: Column) -> Rules:
    """The two-wave setup."""
    w1, w2 = numbered(waves, 2)
    return {"w2_over_0.59_w1": 0.59 * w1["length"] < w2["length"], "w2_under_0.64_w1": w2["length"] < 0.64 * w1["length"], "w2_lasts_a_ninth": 9 * w2["duration"] > w1["duration"]}


def leading_diagonal(waves: Column) -> Rules:
    """An impulse whose fourth wave overlaps the first, between converging lines."""
    w1, w2, w3, w4, w5 = numbered(waves, 5)
    slope = lambda value, at, x, y: F.try_divide(y[value] - x[value], (y[at] - x[at]).cast("double"))
    lows, highs = slope("low", "low_idx", w2, w4), slope("high", "high_idx", w1, w3)
    rules = {k: v for k, v in impulse(waves).items() if k != "w4_above_w1"}
    return rules | {"lows_steeper": lows > highs, "highs_rise": highs > 0, "w4_below_w1": w4["low"] < w1["high"], "w5_over_0.7_w1": w5["length"] > 0.7 * w1["length"], "w5_shorter_than_w3": w5["length"] < w3["length"]}


RULE_SETS: dict[str, Callable[[Column], Rules]] = {"impulse": impulse, "bearish_impulse": bearish_impulse, "leading_diagonal": leading_diagonal, "Corrective": correction, "td": td_wave}


def check_rule(rules: Rules) -> Column:
    """Whether all conditions hold."""
    out = F.lit(True)
    for condition in rules.values():
        out = out & F.coalesce(condition, F.lit(False))
    return out


def may_hold(names: list[str], begun: list[Column], n: int) -> Column:
    """Whether a chain of n waves that begins like this can still satisfy one of the rule sets. The waves to come are null:
    a condition that needs them is null, that is open, and only what the known waves decide is tested."""
    waves = [*begun, *[F.lit(None).cast(WAVE)] * (n - len(begun))]
    out = F.lit(False)
    for name in names:
        some = F.lit(True)
        for condition in RULE_SETS[name](waves).values():
            some = some & F.coalesce(condition, F.lit(True))
        out = out | some
    return out


def first_violation(rules: Rules) -> Column:
    """The name of the first condition that fails; null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules.items()])


def score_rule(rules: Rules, lengths: dict[str, tuple[Column, Column]] | None = None) -> Column:
    """Mean over the conditions of (holds) + bonus, clamped to [0, 1]. lengths: for conditions on two waves
    their lengths; the bonus is what their relative difference leaves of 0.3."""
    lengths, total = lengths or {}, F.lit(0.0)
    for name, condition in rules.items():
        bonus = F.lit(0.0)
        if name in lengths:
            a, b = lengths[name]
            larger = F.greatest(a, b)
            bonus = F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 0.3 - F.abs(a - b) / larger)).otherwise(0.0)
        total = total + F.least(F.lit(1.0), F.coalesce(condition, F.lit(False)).cast("double") + bonus)
    return total / len(rules)
