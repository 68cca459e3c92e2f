"""Validation of stored patterns, and quality of the pattern table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import kept

FIELDS = ("symbol", "start_row", "window_len", "date_start", "date_end", "best", "ensemble_score", "fib_score")


def stored_rules(waves: Column, rule: Column) -> Column:
    """The checks on a stored pattern as array of (name, holds); null where a wave is missing."""
    w = [F.get(waves, F.lit(i)) for i in range(5)]
    pair = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("holds"))
    shortest = ~((w[2]["length"] < w[0]["length"]) & (w[2]["length"] < w[4]["length"]))
    up = [pair("w2_above_start", w[1]["low"] > w[0]["low"]), pair("w3_not_shortest", shortest), pair("w3_over_w1", w[2]["high"] > w[0]["high"]), pair("w5_over_w3", w[4]["high"] > w[2]["high"]), pair("w3_longer_than_w2", w[2]["length"] > w[1]["length"])]
    down = [pair("w2_below_start", w[1]["high"] < w[0]["high"]), pair("w3_not_shortest", shortest), pair("w3_under_w1", w[2]["low"] < w[0]["low"]), pair("w5_under_w3", w[4]["low"] < w[2]["low"]), pair("w3_longer_than_w2", w[2]["length"] > w[1]["length"])]
    three = [pair("b_below_start", w[1]["high"] < w[0]["high"]), pair("c_below_a", w[2]["low"] < w[0]["low"])]
    name = F.lower(rule)
    return (
        F.when(name == "impulse", F.array(*up, pair("w4_above_w1", w[3]["low"] > w[0]["high"])))
        .when(name == "leading_diagonal", F.array(*up, pair("w4_overlaps_w1", w[3]["low"] < w[0]["high"])))
        .when(name == "bearish_impulse", F.array(*down, pair("w4_below_w1", w[3]["high"] < w[0]["low"])))
        .when(name == "corrective", F.array(*three))
    )


def validate_patterns(df: DataFrame) -> DataFrame:
    """Adds passes, violations, unknown (arrays of rule names) and verdict."""
    rules = stored_rules(F.col("waves"), F.col("rule_name"))
    df = df.withColumn("_r", F.coalesce(rules, F.array().cast("array<struct<name:string,holds:boolean>>")))
    pick = lambda test: F.transform(F.filter("_r", test), lambda x: x["name"])
    df = df.withColumns({"passes": pick(lambda x: x["holds"]), "violations": pick(lambda x: ~x["holds"]), "unknown": pick(lambda x: x["holds"].isNull())})
    verdict = F.when(F.size("violations") > 0, "invalid").when((F.size("_r") == 0) | (F.size("unknown") > 0), "unknown").otherwise("valid")
    return df.withColumn("verdict", verdict).drop("_r")


def validation_summary(validated: DataFrame) -> DataFrame:
    """Counts by rule and verdict."""
    return validated.groupBy(F.lower("rule_name").alias("rule"), "verdict").agg(F.count("*").alias("n"))


def violation_counts(validated: DataFrame, k: int = 10) -> DataFrame:
    return validated.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "violation").limit(k)


def violation_samples(validated: DataFrame, k: int = 3, order_cols: tuple[str, ...] = ("symbol", "start", "rule_name")) -> DataFrame:
    """At most k patterns per violation."""
    each = validated.select(F.explode("violations").alias("violation"), *order_cols)
    return each.withColumn("nth", F.row_number().over(Window.partitionBy("violation").orderBy(*order_cols))).where(F.col("nth") <= k)


def grade(share: Column, limits: tuple[tuple[float, str], ...] = ((0.95, "EXCELLENT"), (0.85, "GOOD"), (0.7, "FAIR"))) -> Column:
    out = F.when(share >= limits[0][0], limits[0][1])
    for limit, name in limits[1:]:
        out = out.when(share >= limit, name)
    return out.otherwise("POOR")


def validation_grade(validated: DataFrame) -> DataFrame:
    share = F.avg((F.col("verdict") == "valid").cast("double"))
    return validated.agg(F.count("*").alias("n"), share.alias("valid_share"), grade(share).alias("grade"))


def segment_waves(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Cuts a pattern's bars (start to end) in five (corrections: three) equal parts that share their border bars,
    and takes each part's low and high: symbol, start, rule_name, part, low, high. Patterns of fewer than 20 (10)
    bars give none. A part meets its own bars only."""
    five = F.lower("rule_name") != "corrective"
    p = patterns.select("symbol", "interval", "start", "end", "rule_name", F.when(five, 5).otherwise(3).alias("parts"), (F.col("end") - F.col("start") + 1).alias("n"))
    p = p.where(F.col("n") >= F.when(F.col("parts") == 5, 20).otherwise(10)).withColumn("size", F.floor(F.col("n") / F.col("parts")))
    part = F.explode(F.sequence(F.lit(1), "parts")).alias("part")
    p = p.select("symbol", "interval", "start", "end", "rule_name", "size", part)
    p = p.withColumns({"a": F.col("start") + (F.col("part") - 1) * F.col("size"), "b": F.least(F.col("end"), F.col("start") + F.col("part") * F.col("size"))})
    held = p.withColumn("bar_idx", F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int")))).join(bars.select("symbol", "interval", "bar_idx", "low", "high"), ["symbol", "interval", "bar_idx"])
    return held.groupBy("symbol", "start", "rule_name", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def segments_wide(segments: DataFrame) -> DataFrame:
    cols = [F.max(F.when(F.col("part") == i, F.col(c))).alias(f"{c}{i}") for i in range(1, 6) for c in ("low", "high")]
    return segments.groupBy("symbol", "start", "rule_name").agg(*cols)


def rule_margins(wide: DataFrame) -> DataFrame:
    """Hard rules of segment waves with the margin in per cent of the level that they test."""
    margin = lambda a, b: F.try_divide(100 * (a - b), F.abs(b))
    c = F.col
    three, five = F.lower("rule_name") == "corrective", F.lower("rule_name") != "corrective"
    out = {
        "w2_margin": F.when(five, margin(c("low2"), c("low1"))), "w4_margin": F.when(five, margin(c("low4"), c("high1"))), "w3_margin": F.when(five, margin(c("high3"), c("high1"))),
        "w5_margin": F.when(five, margin(c("high5"), c("high3"))), "b_margin": F.when(three, margin(c("high1"), c("high2"))), "c_margin": F.when(three, margin(c("low1"), c("low3"))),
    }
    wide = wide.withColumns(out)
    size = [c(f"high{i}") - c(f"low{i}") for i in (1, 3, 5)]
    not_shortest = ~((size[1] < size[0]) & (size[1] < size[2]))
    ok = F.when(five, (c("w2_margin") > 0) & (c("w4_margin") > 0) & (c("w3_margin") > 0) & (c("w5_margin") > 0) & not_shortest).otherwise((c("b_margin") > 0) & (c("c_margin") > 0))
    return wide.select("symbol", "start", "rule_name", *out, F.coalesce(ok, F.lit(False)).alias("is_valid"))


#: Ideal and acceptable ranges of the ratios of wave lengths.
FIB_RANGES = {"w2_w1": ((0.382, 0.786), (0.236, 0.886)), "w3_w1": ((1.618, 2.618), (1.0, 4.236)), "w4_w3": ((0.236, 0.5), (0.146, 0.618))}


def fib_quality(df: DataFrame) -> DataFrame:
    """Adds <ratio>_quality: ideal, acceptable, poor or unknown."""
    w = lambda i: F.get("waves", F.lit(i))["length"]
    ratios = {"w2_w1": F.try_divide(w(1), w(0)), "w3_w1": F.try_divide(w(2), w(0)), "w4_w3": F.try_divide(w(3), w(2))}
    inside = lambda r, ab: (r >= ab[0]) & (r <= ab[1])
    return df.withColumns({f"{k}_quality": F.when(r.isNull(), "unknown").when(inside(r, FIB_RANGES[k][0]), "ideal").when(inside(r, FIB_RANGES[k][1]), "acceptable").otherwise("poor") for k, r in ratios.items()})


def validity_report(df: DataFrame, valid: Column) -> DataFrame:
    """Per rule: patterns, valid ones in per cent, mean scores of valid and invalid ones, grade at 80 and 60 per cent."""
    pct = 100 * F.avg(valid.cast("double"))
    return df.groupBy(F.lower("rule_name").alias("rule")).agg(
        F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), pct.alias("valid_pct"), F.avg(F.when(valid, F.col("ensemble_score"))).alias("mean_valid"),
        F.avg(F.when(~valid, F.col("ensemble_score"))).alias("mean_invalid"), F.when(pct >= 80, "GOOD").when(pct >= 60, "FAIR").otherwise("POOR").alias("grade"),
    )


def report_counts(validated: DataFrame) -> DataFrame:
    """What the validity report counts beside its rules: each violation, and each quality of each ratio (fib_quality):
    kind, name, n."""
    violations = validated.select(F.lit("violation").alias("kind"), F.explode("violations").alias("name"))
    rated = fib_quality(validated).select(F.explode(F.array(*[F.struct(F.lit(f"{k}_quality").alias("kind"), F.col(f"{k}_quality").alias("name")) for k in FIB_RANGES])).alias("r")).select("r.*")
    return violations.unionByName(rated).groupBy("kind", "name").agg(F.count("*").alias("n"))


def split_validity(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(valid), df.where(~F.coalesce(valid, F.lit(False)))


def completeness(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Nulls per field, in number and per cent."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("nulls")) for f in fields])).alias("r")
    return counts.select("n", rows).select("r.field", "r.nulls", F.coalesce(F.try_divide(100.0 * F.col("r.nulls"), F.col("n").cast("double")), F.lit(0.0)).alias("pct"))


def unstructured(df: DataFrame, best: str) -> DataFrame:
    """How many rows have a best pattern (JSON text) that is no object, or none."""
    return df.agg(F.count_if(~F.coalesce(F.ltrim(F.col(best)).startswith("{"), F.lit(False))).alias("not_struct"))


def dataset_issues(df: DataFrame, fields: tuple[str, ...], key: tuple[str, ...], as_of: str, order_cols: tuple[str, ...]) -> DataFrame:
    """The issues of all checks, a row each (category, issue): what quality_verdict counts."""
    complete = completeness(df, fields).where("nulls > 0").select(F.lit("completeness").alias("category"), F.concat(F.lit("Missing "), "field").alias("issue"))

    def flags(category: str, one: DataFrame, tests: dict[str, Column]) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(test.alias("holds"), F.lit(text).alias("issue")) for text, test in tests.items()])).alias("r")
        return one.select(rows).where("r.holds").select(F.lit(category).alias("category"), "r.issue")

    scores = flags("scores", score_anomalies(df, order_cols), {
        "Low score variance": F.col("low_spread"), "Most scores are the same": F.col("mostly_one_score"), "Too many excellent scores": F.col("mostly_excellent"), "Too many poor scores": F.col("mostly_poor"),
    })
    temporal = flags("temporal", temporal_coverage(df, as_of), {
        "Future dates (data leakage)": F.col("future") > 0, "Patterns under a week": F.col("under_week") > 0, "Patterns over two years": F.col("over_two_years") > 0,
    })
    diverse = flags("diversity", diversity(df), {"One rule dominates": F.col("dominated"), "Symbols over-represented": F.col("over_represented") > 0})
    n = F.col("n")
    sane = flags("statistical", sanity(df, key), {
        "Duplicate patterns": F.col("repeated") > 0, "Scores are redundant": F.col("scores_redundant"), "Sample too small": n < 100, "Sample marginal": (n >= 100) & (n < 1000),
    })
    return complete.unionByName(scores).unionByName(temporal).unionByName(diverse).unionByName(sane)


def score_anomalies(df: DataFrame, order_cols: tuple[str, ...], col: str = "ensemble_score") -> DataFrame:
    """Flags: hardly any spread; more than half equal to the first; over nine tenths excellent; over half poor."""
    first = F.min_by(col, F.struct(*order_cols))
    per = df.agg(first.alias("first"), F.stddev_samp(col).alias("std"), F.avg((F.col(col) >= 0.85).cast("double")).alias("excellent"), F.avg((F.col(col) < 0.5).cast("double")).alias("poor"))
    same = df.select(col).join(F.broadcast(per)).agg(F.avg((F.col(col) == F.col("first")).cast("double")).alias("same"), F.first("std").alias("std"), F.first("excellent").alias("excellent"), F.first("poor").alias("poor"))  # one row
    return same.select((F.col("std") < 0.01).alias("low_spread"), (F.col("same") > 0.5).alias("mostly_one_score"), (F.col("excellent") > 0.9).alias("mostly_excellent"), (F.col("poor") > 0.5).alias("mostly_poor"))


def temporal_coverage(df: DataFrame, as_of: str) -> DataFrame:
    days = F.date_diff(F.to_date("date_end"), F.to_date("date_start"))
    return df.agg(F.min("date_start").alias("first"), F.max("date_end").alias("last"), F.count_if(F.col("date_end") > F.lit(as_of).cast("timestamp_ntz")).alias("future"), F.count_if(days < 7).alias("under_week"), F.count_if(days > 730).alias("over_two_years"))


def diversity(df: DataFrame) -> DataFrame:
    """Share of the most frequent rule, and symbols with more patterns than mean + 2 deviations."""
    rules = df.groupBy("rule_name").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("top_share"))
    per = df.groupBy("symbol").agg(F.count("*").alias("k"))
    limits = per.agg((F.avg("k") + 2 * F.coalesce(F.stddev_samp("k"), F.lit(0.0))).alias("limit"))
    over = per.join(F.broadcast(limits)).agg(F.count_if(F.col("k") > F.col("limit")).alias("over_represented"))  # one row
    return rules.join(over).select("top_share", (F.col("top_share") > 0.95).alias("dominated"), "over_represented")


def over_represented(df: DataFrame, k: int = 5, buckets: int | None = None) -> DataFrame:
    """The k symbols of most patterns among those with more than mean + 2 deviations. Only counts by series are kept, so of
    patterns that are not stored yet, no more than whether they exist is worked out; with buckets, they are dealt to so many."""
    some = kept(df.groupBy("symbol", "interval").agg(F.count("*").alias("n")), buckets)
    per = some.groupBy("symbol").agg(F.sum("n").alias("n"))
    limits = per.agg((F.avg("n") + 2 * F.coalesce(F.stddev_samp("n"), F.lit(0.0))).alias("limit"))
    return per.join(F.broadcast(limits)).where("n > limit").orderBy(F.desc("n"), "symbol").limit(k).select("symbol", "n")


def sanity(df: DataFrame, key: tuple[str, ...], col: str = "ensemble_score") -> DataFrame:
    """Repeated keys, interquartile outliers, whether scores are one and the same measure, sample size class."""
    q = df.agg(F.percentile(col, F.lit(0.25)).alias("q1"), F.percentile(col, F.lit(0.75)).alias("q3"))
    keys = df.select(*key).distinct().agg(F.count("*").alias("keys"))
    out = (F.col(col) < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col(col) > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    per = df.select(col, "fib_score").join(F.broadcast(q)).agg(F.count("*").alias("n"), F.count_if(out).alias("outliers"), (F.coalesce(F.corr(col, "fib_score"), F.lit(0.0)) > 0.99).alias("scores_redundant"))
    size = F.when(F.col("n") < 30, "too small").when(F.col("n") < 100, "small").when(F.col("n") < 1000, "adequate").otherwise("large")
    return per.join(keys).select("n", (F.col("n") - F.col("keys")).alias("repeated"), "outliers", "scores_redundant", size.alias("sample_size"))


def quality_verdict(issues: DataFrame) -> DataFrame:
    """From rows of text: their number, the verdict, and how many are critical by keyword."""
    n = F.count("issue")
    verdict = F.when(n == 0, "EXCELLENT").when(n <= 3, "GOOD").when(n <= 10, "FAIR").otherwise("POOR")
    return issues.agg(n.alias("issues"), verdict.alias("verdict"), F.count_if(F.lower("issue").rlike("leakage|duplicate|too small")).alias("critical"))
