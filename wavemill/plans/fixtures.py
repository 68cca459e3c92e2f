"""Bars and patterns over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.scoring import ensemble_score
from ..operators import chains as C
from ..operators.resample import index_bars, pyramid, ticks_to_bars
from ..operators.swings import monowaves
from ..operators.tables import buckets_for, kept, merged, short_series


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, by: str) -> tuple[DataFrame, F.Column]:
    """Prices of line items by nation or supplier, and their order."""
    items = read(spark, sf_dir, "lineitem")
    if by == "nation":
        suppliers = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("symbol"))
        items = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    else:
        items = items.withColumn("symbol", F.col("l_suppkey").cast("string"))
    keep = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return items.select("symbol", F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), *keep), F.struct(*keep)


def weekly_bars(spark: SparkSession, sf_dir: str, by: str = "nation", buckets: int | None = None) -> DataFrame:
    """Indexed weekly bars. Suppliers' bars have two or three ticks each, so with buckets, ticks are dealt rather than parts of
    bars; nations have many."""
    rows, order = ticks(spark, sf_dir, by)
    if buckets and by == "supplier":
        rows = rows.repartition(buckets, "symbol")
    return index_bars(ticks_to_bars(rows, "week", "1wk", order))


def kept_bars(spark: SparkSession, sf_dir: str, by: str = "nation") -> tuple[DataFrame, int | None]:
    """Indexed weekly bars, kept in buckets of series, and how many; none if a series is too long for one."""
    buckets = buckets_for(read(spark, sf_dir, "lineitem"))
    bars = kept(weekly_bars(spark, sf_dir, by, buckets), buckets, merge=False)
    return (merged(bars), buckets) if short_series(bars) else (bars, None)


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bars of one tick."""
    value = F.col("value")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("symbol"), F.lit("tick").alias("interval"), F.col("ts").cast("timestamp_ntz").alias("bar_ts"), value.alias("open"), value.alias("high"), value.alias("low"), value.alias("close"),
        F.lit(1.0).alias("volume"), F.col("event_type").alias("source_category"), "event_id",
    )


def timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed bars of 1h, 4h, 1d and 1wk of the events of each type."""
    ticks = user_bars(spark, sf_dir).withColumn("symbol", F.col("source_category"))
    return kept(index_bars(pyramid(ticks, order=F.struct("bar_ts", "event_id"))))


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daily bars with every kind of fault, by order number; ord is the ingest order."""
    p, o = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_orderkey")
    rows = read(spark, sf_dir, "lineitem")
    ingest = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return rows.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.when(o % 3 == 0, "1h").otherwise("1d").alias("interval"), F.col("l_shipdate").cast("timestamp_ntz").alias("bar_ts"), F.when(o % 89 != 0, p).alias("open"),
        F.when(o % 31 == 0, p * 0.9).otherwise(p * 1.01).alias("high"), F.when(o % 37 == 0, p * 1.005).otherwise(p * 0.99).alias("low"), F.when(o % 41 == 0, -p).when(o % 43 == 0, p * 30).otherwise(p).alias("close"),
        F.when(o % 47 == 0, -1.0).otherwise(F.col("l_quantity")).alias("volume"), F.col("l_returnflag").alias("source_category"), ingest.alias("ord"),
    )


def simple_edges(bars: DataFrame, buckets: int | None = None) -> DataFrame:
    """First swings of both directions as edges of skip 0."""
    return kept(monowaves(bars, 0), buckets, dealt=bool(buckets))


def simple_patterns(spark: SparkSession, sf_dir: str, by: str = "nation") -> DataFrame:
    """The patterns over weekly bars."""
    return patterns_over(*kept_bars(spark, sf_dir, by))


def simple_chains(bars: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every complete chain of first swings over bars with a positive first wave, whether its rules hold (passes) or not: a
    row for each of the patterns."""
    edges = simple_edges(bars, buckets)
    w = F.col("waves")
    out = None
    for family, name, rule in (("impulse", "impulse", R.impulse), ("bearish_impulse", "bearish_impulse", R.bearish_impulse), ("corrective", "Corrective", R.correction)):
        found = C.chains(edges, family).where(w[0]["length"] > 0).withColumns({"rule_name": F.lit(name), "rule_score": R.score_rule(rule(w)), "passes": R.check_rule(rule(w))})
        out = found if out is None else out.unionByName(found)
    return out


def patterns_over(bars: DataFrame, buckets: int | None = None) -> DataFrame:
    """The chains as a pattern table: impulses, bearish impulses and corrections, with scores and dates."""
    out = simple_chains(bars, buckets)
    parts = ensemble_score(F.col("waves"), F.col("rule_score"))
    out = out.withColumns({"ensemble_score": parts["score"], "fib_score": parts["fib"], "time_score": parts["time"], "end": F.element_at("waves", -1)["idx_end"]})
    at = lambda n, c: bars.select("symbol", "interval", F.col("bar_idx").alias(c), F.col("bar_ts").alias(n))
    return kept(out.drop("turns", "prefix_need").join(at("date_start", "start"), ["symbol", "interval", "start"]).join(at("date_end", "end"), ["symbol", "interval", "end"]), buckets)
