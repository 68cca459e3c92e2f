"""Patterns of patterns: a pattern that satisfies its rules is one wave of the next degree, which later patterns may be
made of, until nothing new is found.

The iteration is semi-naive: a round joins only chains that hold at least one wave that the round before has found (waves
before it are older, waves after it are of any age), so no chain is found twice. It begins with the new waves, at each of
their places in a chain, and goes on to either side, so that its work follows their number. A rolled-up wave is longer than each of its
parts, so the rounds end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.scoring import ensemble_score
from ..functions.waves import wave_struct
from . import chains as C
from .tables import kept

SERIES = ("symbol", "interval")
EDGE = (*SERIES, "s", "e", "up", "low", "high", "turn", "degree")


def chained(sides: list[DataFrame], family: str) -> DataFrame:
    """The family's chains of waves, one from each side in turn, that satisfy a rule set and the guard; beginnings go as
    soon as they break them."""
    plan, n = C.FAMILIES[family], len(C.FAMILIES[family])
    wave = lambda i: wave_struct(*plan[i], F.col(f"s{i}"), F.col(f"s{i + 1}"), F.col(f"lo{i}"), F.col(f"hi{i}"))
    out = None
    for i, ((_, up), edges) in enumerate(zip(plan, sides, strict=True)):
        names = {"s": f"s{i}", "e": f"s{i + 1}", "low": f"lo{i}", "high": f"hi{i}", "turn": f"t{i}"} | ({"degree": "degree"} if not i else {})
        side = edges.where(F.col("up") == up).select(*SERIES, *[F.col(c).alias(name) for c, name in names.items()])
        out = side.where("hi0 > lo0") if out is None else out.join(side, [*SERIES, f"s{i}"])
        if i:
            out = out.where(R.may_hold(C.RULES[family], [wave(j) for j in range(i + 1)], n))
        if n == 5 and i == 3:
            out = out.where("s4 > s2 and t1 >= s4")
        if n == 5 and i == 4:
            out = out.where("s5 = s4 or t3 >= s5")
    rule = F.coalesce(*[F.when(R.check_rule(R.RULE_SETS[name](F.col("waves"))), F.lit(name)) for name in C.RULES[family]])
    found = out.select(*SERIES, F.col("s0").alias("start"), "degree", F.array(*[wave(i) for i in range(n)]).alias("waves"), F.col(f"t{n - 1}").alias("turn"))
    return found.withColumn("rule_name", rule).where("rule_name is not null")


def grown(older: DataFrame, new: DataFrame, every: DataFrame, family: str) -> DataFrame:
    """The family's chains whose first new wave is at any place, with older ones before it and waves of every age after it,
    that satisfy a rule set and the guard. A chain goes on to the right, then to the left; waves still to come are null."""
    plan, n = C.FAMILIES[family], len(C.FAMILIES[family])
    slot = F.struct("s", "e", "low", "high", "turn", "degree")
    places = [F.array(*[F.lit(i) for i, (_, up) in enumerate(plan) if up == way]) for way in (True, False)]
    out = new.select(*SERIES, slot.alias("_new"), F.explode(F.when(F.col("up"), places[0]).otherwise(places[1])).alias("_i"))
    out = out.select(*SERIES, "_i", *[F.when(F.col("_i") == j, F.col("_new")).alias(f"w{j}") for j in range(n)])
    w = [F.col(f"w{j}") for j in range(n)]
    wave = lambda j: wave_struct(*plan[j], w[j]["s"], w[j]["e"], w[j]["low"], w[j]["high"])
    tests = [R.may_hold(C.RULES[family], [wave(j) for j in range(n)], n), w[0]["high"] > w[0]["low"]]
    if n == 5:
        tests += [(w[3]["e"] > w[1]["e"]) & (w[1]["turn"] >= w[3]["e"]), (w[4]["e"] == w[3]["e"]) | (w[3]["turn"] >= w[4]["e"])]
    for j, right in [*[(j, True) for j in range(1, n)], *[(j, False) for j in range(n - 2, -1, -1)]]:
        side = (every if right else older).where(F.col("up") == plan[j][1]).select(*SERIES, F.col("s" if right else "e").alias("_at"), slot.alias("_w"))
        asks = F.col("_i") < j if right else F.col("_i") > j
        out = out.withColumn("_at", F.when(asks, w[j - 1]["e"] if right else w[j + 1]["s"])).join(side, [*SERIES, "_at"], "left")
        out = out.where(~asks | F.col("_w").isNotNull()).withColumn(f"w{j}", F.coalesce(f"w{j}", "_w")).drop("_at", "_w")
        for test in tests:
            out = out.where(F.coalesce(test, F.lit(True)))
    rule = F.coalesce(*[F.when(R.check_rule(R.RULE_SETS[name](F.col("waves"))), F.lit(name)) for name in C.RULES[family]])
    found = out.select(*SERIES, w[0]["s"].alias("start"), w[0]["degree"].alias("degree"), F.array(*[wave(j) for j in range(n)]).alias("waves"), w[-1]["turn"].alias("turn"))
    return found.withColumn("rule_name", rule).where("rule_name is not null")


def patterns_of_degrees(edges: DataFrame, families: tuple[str, ...] = ("impulse", "bearish_impulse", "corrective"), most: int = 20, buckets: int | None = None) -> DataFrame:
    """start, rule_name, degree (of the first wave, whatever the others'), waves, score parts and round of all patterns over
    the edges and, from round to round, over the patterns rolled up. At most so many rounds, or an error.
    buckets: of the edges, if they are dealt by series (see tables)."""
    new = kept(edges.select(*SERIES, "s", "e", "up", "low", "high", "turn", F.lit(1).alias("degree")).distinct(), buckets)
    every, older, found = new, None, []
    for nth in range(1, most + 1):
        # in the first round, nothing is older
        chains = [chained([new] * len(C.FAMILIES[f]), f) if older is None else grown(older, new, every, f) for f in families]
        some = kept(reduce(DataFrame.unionByName, chains).withColumn("round", F.lit(nth)), buckets)
        found.append(some)
        up = F.col("rule_name").isin("impulse", "leading_diagonal")
        first, last = F.col("waves")[0], F.element_at("waves", -1)
        low, high = F.when(up, first["low"]).otherwise(last["low"]), F.when(up, last["high"]).otherwise(first["high"])
        rolled = some.select(*SERIES, first["idx_start"].alias("s"), last["idx_end"].alias("e"), up.alias("up"), low.alias("low"), high.alias("high"), "turn", (F.col("degree") + 1).alias("degree"))
        older, new = every, kept(rolled.distinct().join(every, list(EDGE), "left_anti").select(*EDGE), buckets)
        if not new.limit(1).count():
            scores = ensemble_score(F.col("waves"), F.lit(1.0), degree=F.col("degree"))
            return reduce(DataFrame.unionByName, found).withColumn("scores", scores).select("*", F.col("scores.score").alias("ensemble_score"), F.col("scores.complexity").alias("complexity_score")).drop("scores", "turn")
        every = kept(every.unionByName(new), buckets)
    raise RuntimeError(f"patterns have not settled in {most} rounds")
