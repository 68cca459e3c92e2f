"""Statistics of the pattern table: columns symbol, rule_name, ensemble_score, fib_score, wave_config, start, end, date_start, date_end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIERS = ((0.85, "excellent"), (0.7, "good"), (0.5, "fair"))


def exclusive_quartiles(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """q25 and q75 at position (n + 1) p between sorted values, the ends for fewer than four; by ranks, so that a
    group need not fit in memory."""
    w = Window.partitionBy(*by)
    r = df.where(F.col(col).isNotNull()).select(*by, F.col(col).alias("_x"), F.row_number().over(w.orderBy(col)).alias("_r"), F.count("*").over(w).alias("_n"))

    def quartile(p: float) -> Column:
        at = (F.col("_n") + 1) * p
        below = F.floor(at)
        inner = F.max(F.when(F.col("_r") == below, F.col("_x"))) + F.max(at - below) * (F.max(F.when(F.col("_r") == F.least(below + 1, F.col("_n")), F.col("_x"))) - F.max(F.when(F.col("_r") == below, F.col("_x"))))
        return F.when(F.max("_n") < 4, F.min("_x") if p < 0.5 else F.max("_x")).otherwise(inner)

    return r.groupBy(*by).agg(quartile(0.25).alias("q25"), quartile(0.75).alias("q75"))


def score_distribution(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """count, min, max, mean, median, sample deviation (0 for one), exclusive quartiles."""
    base = df.groupBy(*by).agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"), F.median(col).alias("median"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("stdev"))
    return base.join(exclusive_quartiles(df, col, by), by)


def score_stats(df: DataFrame, col: str = "ensemble_score") -> DataFrame:
    """mean, median, population deviation, range and linear quartiles."""
    return df.agg(F.avg(col).alias("mean"), F.median(col).alias("median"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"), F.percentile(col, F.lit(0.25)).alias("q25"), F.percentile(col, F.lit(0.75)).alias("q75"))


def tier(score: Column) -> Column:
    out = F.when(score >= TIERS[0][0], TIERS[0][1])
    for limit, name in TIERS[1:]:
        out = out.when(score >= limit, name)
    return out.otherwise("poor")


def share(counted: DataFrame) -> DataFrame:
    """Adds pct of n, over a handful of rows."""
    return counted.withColumn("pct", F.coalesce(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(0.0)))


def quality_tiers(df: DataFrame, col: str = "ensemble_score") -> DataFrame:
    names = df.sparkSession.createDataFrame([(t,) for t in ("excellent", "good", "fair", "poor")], "tier string")
    counted = df.groupBy(tier(F.col(col)).alias("tier")).agg(F.count("*").alias("n"))
    return share(names.join(counted, "tier", "left").fillna(0, ["n"]))


def type_counts(df: DataFrame) -> DataFrame:
    return share(df.groupBy(F.lower("rule_name").alias("rule")).agg(F.count("*").alias("n")))


def by_symbol(df: DataFrame) -> DataFrame:
    """Per symbol: patterns, score means and ranges, and counts by rule as a map."""
    rules = df.groupBy("symbol", F.lower("rule_name").alias("rule")).agg(F.count("*").alias("k"))
    maps = rules.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "k")))).alias("rules"))
    ensemble, fib = score_distribution(df, "ensemble_score", ["symbol"]), score_distribution(df, "fib_score", ["symbol"])
    fib = fib.select("symbol", *[F.col(c).alias(f"fib_{c}") for c in fib.columns if c not in ("symbol", "n")])
    return ensemble.join(fib, "symbol").join(maps, "symbol")


def symbol_coverage(df: DataFrame) -> DataFrame:
    per = df.groupBy("symbol").agg(F.count("*").alias("n"))
    return per.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))


def extreme_symbols(df: DataFrame, k: int = 10) -> DataFrame:
    """The k symbols with most and the k with least patterns, ties by name."""
    per = df.groupBy("symbol").agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "symbol").limit(k).withColumn("side", F.lit("top")).union(per.orderBy("n", "symbol").limit(k).withColumn("side", F.lit("bottom")))


def config_counts(df: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent wave configurations, as text."""
    text = F.array_join(F.transform("wave_config", lambda x: x.cast("string")), ",")
    return df.where(F.forall("wave_config", lambda x: x.isNotNull())).groupBy(text.alias("config")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "config").limit(k)


def config_stats(df: DataFrame) -> DataFrame:
    """Valid and distinct configurations, and the patterns' lengths in bars."""
    valid = F.forall("wave_config", lambda x: x.isNotNull())
    size = F.col("end") - F.col("start")
    return df.agg(F.count_if(valid).alias("valid"), F.countDistinct(F.when(valid, F.col("wave_config"))).alias("distinct_configs"), F.avg(size).alias("mean_length"), F.median(size).alias("median_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"))


def temporal_stats(df: DataFrame) -> DataFrame:
    """Per start year: patterns and their days."""
    days = F.date_diff(F.to_date("date_end"), F.to_date("date_start"))
    return df.groupBy(F.year("date_start").alias("year")).agg(F.count("*").alias("n"), F.avg(days).alias("mean_days"), F.median(days).alias("median_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"))


def scores_by_type(df: DataFrame) -> DataFrame:
    family = F.when(F.lower("rule_name").contains("corrective"), "corrective").otherwise("impulse")
    return df.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.avg("ensemble_score").alias("mean"), F.median("ensemble_score").alias("median"))


def basic_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("patterns"), F.countDistinct("symbol").alias("symbols"))


def run_stats(symbols: DataFrame, df: DataFrame) -> DataFrame:
    """Symbols in all, with patterns, patterns per symbol, and the mean of the symbols' best scores."""
    per = symbols.select("symbol").distinct().join(df.groupBy("symbol").agg(F.count("*").alias("n"), F.max("ensemble_score").alias("best")), "symbol", "left")
    return per.agg(F.count("*").alias("total"), F.count("n").alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("patterns"), F.avg(F.coalesce("n", F.lit(0))).alias("per_symbol"), F.avg("best").alias("mean_best"))
