"""Writers: bars, patterns, trades, and filtered exports with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bars(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").partitionBy("interval").parquet(path)


def write_series(df: DataFrame, table: str, buckets: int = 64) -> None:
    """Bars as a table of the catalog, bucketed by series and sorted by time in each bucket: joins and windows by (symbol,
    interval) over such tables of equally many buckets need no exchange. A bucket is written by one task."""
    dealt = df.repartition(buckets, "symbol", "interval")  # as the buckets, so that each is one file
    dealt.write.mode("overwrite").bucketBy(buckets, "symbol", "interval").sortBy("symbol", "interval", "bar_ts").saveAsTable(table)


def write_patterns(df: DataFrame, path: str) -> None:
    """Patterns as JSON lines, with their counts per interval beside them."""
    df.write.mode("overwrite").json(f"{path}/patterns")
    df.groupBy("interval").agg(F.count("*").alias("patterns")).write.mode("overwrite").json(f"{path}/metadata")


def trade_log(df: DataFrame) -> DataFrame:
    """Trades as text: prices and amounts with two decimals, scores with three."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c)).alias(c)
    return df.select(
        "symbol", F.to_date("entry_date").cast("string").alias("entry_date"), F.to_date("exit_date").cast("string").alias("exit_date"), fixed("entry_price", 2), fixed("exit_price", 2),
        fixed("position_size", 2), "rule_name", fixed("ensemble_score", 3), fixed("return_pct", 2), fixed("profit_loss", 2),
    )


def write_trades(df: DataFrame, path: str) -> None:
    trade_log(df).write.mode("overwrite").option("header", "true").csv(path)


def export_filtered(df: DataFrame, min_score: float, path: str) -> None:
    """Patterns of at least min_score, with the filter and the counts before and after."""
    kept = df.where(F.col("ensemble_score") >= min_score)
    kept.write.mode("overwrite").json(f"{path}/patterns")
    counts = df.agg(F.count("*").alias("original_count"), F.count_if(F.col("ensemble_score") >= min_score).alias("filtered_count"))
    counts.withColumn("filter", F.lit(f"ensemble_score >= {min_score}")).write.mode("overwrite").json(f"{path}/metadata")
