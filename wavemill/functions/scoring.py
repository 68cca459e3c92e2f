"""Fibonacci, time, complexity and ensemble scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ratios that scores measure distances to.
RATIOS = (0.382, 0.5, 0.618, 1.0, 1.272, 1.618, 2.618)
RETRACEMENTS = (0.382, 0.5, 0.618)
WEIGHTS = {"fib": 0.5, "rule": 0.3, "time": 0.1, "complexity": 0.1}


def distance(r: Column, ratios: tuple[float, ...]) -> Column:
    return F.least(*[F.abs(r - x) for x in ratios])


def fib_distance(r: Column) -> Column:
    """Distance to the closest ratio; 999 for ratios of zero or less."""
    return F.when(r <= 0, F.lit(999.0)).otherwise(distance(r, RATIOS))


def steps(d: Column, limits: list[tuple[float, float]], rest: float) -> Column:
    out = F.when(d < limits[0][0], F.lit(limits[0][1]))
    for below, score in limits[1:]:
        out = out.when(d < below, F.lit(score))
    return out.otherwise(F.lit(rest))


def score_retracement(l2: Column, l1: Column) -> Column:
    return F.when(l1 > 0, steps(distance(l2 / l1, RETRACEMENTS), [(0.05, 1.0), (0.15, 0.8), (0.25, 0.5)], 0.2)).otherwise(0.0)


def score_extension(l3: Column, l1: Column) -> Column:
    r = l3 / l1
    return F.when(l1 > 0, F.when(r < 1, F.lit(0.0)).otherwise(steps(F.abs(r - 1.618), [(0.1, 1.0), (0.3, 0.8), (0.5, 0.6)], 0.4))).otherwise(0.0)


def score_wave5(l5: Column, l1: Column, l3: Column) -> Column:
    """The better of wave 5 against wave 1 (equal) and against wave 3 (0.618)."""
    one = lambda d: F.when(d < 0.1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), 1 - d))
    return F.when((l1 > 0) & (l3 > 0), F.greatest(one(F.abs(l5 / l1 - 1)), one(F.abs(l5 / l3 - 0.618)))).otherwise(0.5)


def fib_score(waves: Column) -> Column:
    """Five waves: the mean of the retracement, extension and fifth-wave scores. Three: C over A against 1 and 0.618."""
    length = [waves[i]["length"] for i in range(5)]
    five = (score_retracement(length[1], length[0]) + score_extension(length[2], length[0]) + score_wave5(length[4], length[0], length[2])) / 3
    three = F.when(length[0] > 0, steps(distance(length[2] / length[0], (1.0, 0.618)), [(0.1, 0.9), (0.2, 0.7)], 0.5)).otherwise(0.5)
    return F.when(F.size(waves) == 5, five).when(F.size(waves) == 3, three).otherwise(0.5)


def time_score(waves: Column) -> Column:
    d = [waves[i]["duration"].cast("double") for i in range(3)]
    one = lambda r: F.greatest(F.lit(0.3), 1 - fib_distance(r))
    return F.when((F.size(waves) >= 3) & (d[0] > 0), (one(d[1] / d[0]) + one(d[2] / d[0])) / 2).otherwise(0.5)


def complexity_score(degree: Column) -> Column:
    d = degree.cast("double")
    return F.when(d <= 0, F.lit(1.0)).when(d <= 10, 1 - 0.05 * d).otherwise(F.greatest(F.lit(0.3), 0.5 - 0.01 * (d - 10)))


def ensemble_score(waves: Column, rule_score: Column | None = None, weights: dict[str, float] | None = None, degree: Column | None = None) -> Column:
    """Struct of score and its parts; weights are normalised, the score clamped to [0, 1], a missing rule score is 0.5."""
    w = weights or WEIGHTS
    total = sum(w.values())
    parts = {"fib": fib_score(waves), "rule": F.lit(0.5) if rule_score is None else F.coalesce(rule_score, F.lit(0.5)), "time": time_score(waves), "complexity": complexity_score(F.lit(1) if degree is None else degree)}
    score = F.lit(0.0)
    for name, part in parts.items():
        score = score + part * (w.get(name, 0.0) / total)
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), *[p.alias(n) for n, p in parts.items()])
