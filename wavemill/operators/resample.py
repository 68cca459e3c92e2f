"""Resampling and indexing of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import kept


def ohlcv(order: Column) -> list[Column]:
    """First, greatest, least, last and sum; first and last by order."""
    return [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume")]


#: Widths, names and offsets of the bars of a pyramid: weeks begin on Mondays, four days after the epoch's.
LEVELS = (("1 hour", "1h", None), ("4 hours", "4h", None), ("1 day", "1d", None), ("7 days", "1wk", "4 days"))


def resample_bars(df: DataFrame, width: str, interval: str, order: Column | None = None, offset: str | None = None) -> DataFrame:
    """Bars of the given width (epoch-aligned, or that far from it); empty bins make no row. Works on streams as well."""
    bins = df.groupBy("symbol", F.window("bar_ts", width, startTime=offset).alias("bin")).agg(*ohlcv(F.col("bar_ts") if order is None else order))
    return bins.select("symbol", F.lit(interval).alias("interval"), F.col("bin.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def pyramid(df: DataFrame, levels: tuple[tuple[str, str, str | None], ...] = LEVELS, order: Column | None = None) -> DataFrame:
    """Bars of several widths, each of which holds whole bins of the one before. First, last, greatest, least and sum
    can be merged, so the rows are read for the first level only, and every level is merged from the bars below it."""
    out, below = None, df
    for width, interval, offset in levels:
        below = kept(resample_bars(below, width, interval, order, offset))
        out, order = below if out is None else out.unionByName(below), None
    return out


def ticks_to_bars(ticks: DataFrame, unit: str, interval: str, order: Column) -> DataFrame:
    """Bars of calendar units ('day', 'week') from rows of symbol, ts and price."""
    t = ticks.withColumn("bar_ts", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    return t.groupBy("symbol", "bar_ts").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"),
    ).select("symbol", F.lit(interval).alias("interval"), "bar_ts", "open", "high", "low", "close", "volume")


def index_bars(df: DataFrame) -> DataFrame:
    """Dense bar_idx from 0, by time, for each symbol and interval."""
    return df.withColumn("bar_idx", (F.row_number().over(Window.partitionBy("symbol", "interval").orderBy("bar_ts")) - 1).cast("int"))
