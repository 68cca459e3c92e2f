"""Chains of monowaves: enumeration by joins of the edge table, ranking, deduplication, cycles.

Chains join edges on (series, start bar). Options that begin alike share the joins of what they have in common:
after each wave only the beginnings of options go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.scoring import ensemble_score
from ..functions.waves import wave_struct

SERIES = ("symbol", "interval")
#: Labels and directions (up) of each family's waves.
FAMILIES = {
    "impulse": [("1", True), ("2", False), ("3", True), ("4", False), ("5", True)],
    "bearish_impulse": [("1", False), ("2", True), ("3", False), ("4", True), ("5", False)],
    "corrective": [("A", False), ("B", True), ("C", False)],
    "td": [("1", True), ("2", False)],
}
#: The rule sets that a family's chains may satisfy.
RULES = {"impulse": ["impulse", "leading_diagonal"], "bearish_impulse": ["bearish_impulse"], "corrective": ["Corrective"], "td": ["td"]}


def skip_options(spark: SparkSession, up_to: int, n: int) -> DataFrame:
    """All combinations of n skips below up_to, in lexicographic order: option, skips."""
    ids = spark.range(up_to**n).withColumnRenamed("id", "option")
    return ids.select("option", F.array(*[F.expr(f"cast((option div {up_to ** (n - 1 - i)}) % {up_to} as int)") for i in range(n)]).alias("skips"))


def top_options(options: DataFrame, k: int, max_comb: int = 10**9) -> DataFrame:
    """The min(k, max_comb) options of greatest total skip, ties in lexicographic order, with their rank from 1."""
    total = F.aggregate("skips", F.lit(0), lambda a, b: a + b)
    some = options.withColumn("total", total).orderBy(F.desc("total"), "skips").limit(min(k, max_comb))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "skips"))).drop("total")


def chains(edges: DataFrame, family: str, starts: DataFrame | None = None, options: DataFrame | None = None, complete: bool = False, prune: bool = False, longest: int | None = None) -> DataFrame:
    """waves (array of wave structs) of each start and option, with option rank, need_idx, prefix_need (of all waves but
    the last) and turns (of each wave's end). Without options, the edges' skip 0 only; complete options
    have all combinations of the edges' skips, so none has to be left out on the way. With prune, beginnings go as soon
    as their waves break all of the family's rule sets or its guard, whatever the last wave may be; with longest, so do
    those that no window of so many bars holds."""
    plan = FAMILIES[family]
    n = len(plan)
    wave = lambda i: wave_struct(*plan[i], F.col(f"s{i}"), F.col(f"s{i + 1}"), F.col(f"lo{i}"), F.col(f"hi{i}"))
    if options is None:
        edges = edges.where("skip = 0")
    out = None
    for i, (_, up) in enumerate(plan):
        names = {"s": f"s{i}", "skip": f"k{i}", "e": f"s{i + 1}", "need_idx": f"n{i}", "turn": f"t{i}", "low": f"lo{i}", "high": f"hi{i}"}
        side = edges.where(F.col("up") == up).select(*SERIES, *[F.col(c).alias(name) for c, name in names.items()])
        if out is None:
            out = side if starts is None else side.join(starts.select(*SERIES, F.col("start").alias("s0")), [*SERIES, "s0"], "left_semi")
        else:
            out = out.join(side, [*SERIES, f"s{i}"])
        if options is not None and (i + 1 == n or not complete):  # at most as many rows as options
            begun = F.broadcast(options.select(*[F.col("skips")[j].alias(f"k{j}") for j in range(i + 1)], *["rank"] * (i + 1 == n)).distinct())
            out = out.join(begun, [f"k{j}" for j in range(i + 1)])
        if prune and 0 < i < n - 1:
            out = out.where(R.may_hold(RULES[family], [wave(j) for j in range(i + 1)], n))
            if i == 3:
                out = out.where("s4 > s2 and t1 >= s4")
        if longest is not None and i < n - 1:
            out = out.where(F.col(f"n{i}") - F.col("s0") < longest)
    rank = F.lit(1).alias("rank") if options is None else F.col("rank")
    each = lambda c: F.array(*[F.col(f"{c}{i}") for i in range(n)])
    waves = F.array(*[wave(i) for i in range(n)])
    needs = [F.col(f"n{i}") for i in range(n)]
    return out.select(*SERIES, F.col("s0").alias("start"), rank, each("k").alias("wave_config"), waves.alias("waves"), F.greatest(*needs).alias("need_idx"), F.greatest(*needs[:-1], F.lit(0)).alias("prefix_need"), each("t").alias("turns"))


def guard(found: DataFrame, family: str) -> DataFrame:
    """Motive chains without those in which a bar from the second wave's end to the fourth's, or from the fourth's
    to the fifth's, undercuts (for bearish ones: exceeds) that wave: the bar at which its end is passed comes later."""
    if family not in ("impulse", "bearish_impulse"):
        return found
    end = [F.col("waves")[i]["idx_end"] for i in range(5)]
    return early_guard(found, family).where((end[4] == end[3]) | (F.col("turns")[3] >= end[4]))


def early_guard(found: DataFrame, family: str) -> DataFrame:
    """What the guard says without the last wave."""
    if family not in ("impulse", "bearish_impulse"):
        return found
    second, fourth = (F.col("waves")[i]["idx_end"] for i in (1, 3))
    return found.where((fourth > second) & (F.col("turns")[1] >= fourth))


def cut_short(found: DataFrame, family: str, at: Column, low: Column, high: Column) -> DataFrame:
    """The chains whose last wave, a first swing, is still on its way at a bar, with that wave ending there."""
    label, up = FAMILIES[family][-1]
    last = F.element_at("waves", -1)
    found = found.where((F.element_at("wave_config", -1) == 0) & (F.col("prefix_need") <= at) & (last["idx_start"] < at) & (last["idx_end"] > at))
    part = wave_struct(label, up, last["idx_start"], at, last["low"] if up else low, high if up else last["high"])
    n = len(FAMILIES[family])
    # exploding a list of one keeps Catalyst from working the waves out again wherever a rule names one
    waves = F.explode(F.array(F.concat(F.slice("waves", 1, n - 1), F.array(part))))
    return found.withColumn("_waves", waves).withColumns({"waves": F.col("_waves"), "need_idx": at.cast("int")}).drop("_waves")


def scored(found: DataFrame, family: str) -> DataFrame:
    """The chains that satisfy a rule set of their family: rule_name, score, fib_score, ensemble_score."""
    w = F.col("waves")
    rule = F.lit(None).cast("string")
    for name in RULES[family][::-1]:
        rule = F.when(R.check_rule(R.RULE_SETS[name](w)), F.lit(name)).otherwise(rule)
    found = found.withColumn("rule_name", rule).where("rule_name is not null")
    parts = ensemble_score(w, F.lit(1.0))
    return found.withColumns({"score": F.lit(1.0), "fib_score": parts["fib"], "ensemble_score": parts["score"]})


def vertices(waves: Column) -> Column:
    return F.transform(waves, lambda x: F.struct(x["low"], x["high"]))


def family_order(rule: Column) -> Column:
    """Families are scanned in this order; the first wins ties."""
    return F.when(rule.isin("impulse", "leading_diagonal"), 0).when(rule == "bearish_impulse", 1).when(rule == "Corrective", 2).otherwise(3)


def dedup_candidates(found: DataFrame, by: tuple[str, ...] = (*SERIES, "start")) -> DataFrame:
    """Of candidates of one group (a start; or a window) and family with equal wave prices, the first by start and option."""
    order = Window.partitionBy(*by, family_order(F.col("rule_name")), vertices(F.col("waves"))).orderBy("start", "rank")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_of_window(found: DataFrame, n: int, window: tuple[str, ...], families: int = 3) -> DataFrame:
    """The n best candidates of each window, with nth: within a start, equal prices count once per family, each family
    has its 2n best (n, if only one is scanned) and all together their n best; then equal prices of later starts go."""
    end = F.element_at("waves", -1)["idx_end"]
    family = family_order(F.col("rule_name"))
    best = [F.desc("ensemble_score"), end.desc()]

    def first(df: DataFrame, by: list, order: list, most: int) -> DataFrame:
        return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= most)

    if n > 1:
        found = first(found, [*window, "start", family, vertices(F.col("waves"))], ["rank"], 1)
        found = first(found, [*window, "start", family], [*best, "rank"], 2 * n if families > 1 else n)
        found = first(found, [*window, "start"], [*best, family, "rank"], n)
        found = first(found, [*window, family, vertices(F.col("waves"))], ["start", *best, "rank"], 1)
    # for the best alone, none of that matters: what goes is no better than what stays
    tie = "rank" if "rank" in found.columns else "wave_config"
    return first(found, list(window), [*best, "start", family, tie], n)


def rank_patterns(found: DataFrame, n: int, by: tuple[str, ...] = (*SERIES, "start")) -> DataFrame:
    """The n best of each group by ensemble score, then later end, then rule name and option."""
    end = F.element_at("waves", -1)["idx_end"]
    order = Window.partitionBy(*by).orderBy(F.desc("ensemble_score"), end.desc(), "rule_name", "wave_config", "start")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def best_per_window(found: DataFrame) -> DataFrame:
    """One record per window (symbol, interval, start_row, window_len) with the best pattern and its waves by label."""
    best = rank_patterns(found, 1, (*SERIES, "start_row", "window_len"))
    waves = F.map_from_arrays(F.transform("waves", lambda x: F.concat(F.lit("wave"), x["label"])), F.col("waves"))
    one = F.struct("rule_name", "score", "wave_config", F.col("waves")[0]["idx_start"].alias("idx_start"), F.element_at("waves", -1)["idx_end"].alias("idx_end"), waves.alias("waves"))
    return best.select(*SERIES, "start_row", "window_len", one.alias("best"), "ensemble_score", "fib_score")


def cycles(impulses: DataFrame, corrections: DataFrame) -> DataFrame:
    """The first impulse of each start, by option, that a correction starts from, with each such correction: eight waves."""
    end = F.element_at("waves", -1)["idx_end"]
    pairs = impulses.select(*SERIES, F.col("start").alias("first"), "rank", F.col("waves").alias("_five"), end.alias("start")).join(corrections.select(*SERIES, "start", F.col("waves").alias("_three")), [*SERIES, "start"])
    least = F.min("rank").over(Window.partitionBy(*SERIES, "first"))
    return pairs.withColumn("_least", least).where("rank = _least").select(*SERIES, F.col("first").alias("start"), "rank", F.concat("_five", "_three").alias("waves"))


def dedup_patterns(patterns: DataFrame, order_cols: list[str]) -> DataFrame:
    """Of patterns with one rule, first low, third high and fifth high (rounded to cents, missing is 0), the best by
    ensemble score, the first on ties."""
    w = F.col("waves")
    key = [F.coalesce(F.round(x, 2), F.lit(0.0)) for x in (w[0]["low"], w[2]["high"], F.get("waves", F.lit(4))["high"])]
    order = Window.partitionBy("rule_name", *key).orderBy(F.desc("ensemble_score"), *order_cols)
    return patterns.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def reconstruct(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """Rebuilds waves from (symbol, interval, rule_name, start, wave_config) and checks their rules: adds rebuilt, passes."""
    out = []
    for family, names in (("impulse", ["impulse", "leading_diagonal"]), ("bearish_impulse", ["bearish_impulse"]), ("corrective", ["Corrective"])):
        mine, plan = patterns.where(F.col("rule_name").isin(names)), FAMILIES[family]
        here = mine.withColumn("_at", F.col("start"))
        for i, (label, up) in enumerate(plan):
            side = edges.where(F.col("up") == up).select(*SERIES, F.col("s").alias("_at"), F.col("skip").alias("_k"), F.col("e").alias("_e"), wave_struct(label, up, F.col("s"), F.col("e"), F.col("low"), F.col("high")).alias(f"_w{i}"))
            here = here.withColumn("_k", F.col("wave_config")[i]).join(side, [*SERIES, "_at", "_k"], "left").drop("_at", "_k").withColumnRenamed("_e", "_at")
        w = F.when(F.col("_at").isNotNull(), F.array(*[F.col(f"_w{i}") for i in range(len(plan))]))
        here = here.withColumn("rebuilt", w).drop("_at", *[f"_w{i}" for i in range(len(plan))])
        passes = F.lit(False)
        for name in names:
            passes = passes | ((F.col("rule_name") == name) & R.check_rule(R.RULE_SETS[name](F.col("rebuilt"))))
        out.append(here.withColumn("passes", F.col("rebuilt").isNotNull() & passes))
    return out[0].unionByName(out[1]).unionByName(out[2])


def hybrid_summary(patterns: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Counts per interval and rule, with totals (null rule; null interval). With the bars that were scanned, also each
    interval's bars and series, and totals of 0 for intervals without patterns."""
    counts = patterns.rollup("interval", "rule_name").agg(F.count("*").alias("n"))
    if bars is None:
        return counts
    per = bars.rollup("interval").agg(F.count("*").alias("bars"), F.countDistinct("symbol").alias("series"))
    each = counts.where("rule_name is not null").join(per, "interval")
    totals = per.withColumnRenamed("interval", "_i").join(counts.where("rule_name is null"), F.col("_i").eqNullSafe(F.col("interval")), "left")
    totals = totals.select(F.col("_i").alias("interval"), F.lit(None).cast("string").alias("rule_name"), F.coalesce("n", F.lit(0)).alias("n"), "bars", "series")
    return each.select(totals.columns).unionByName(totals)
