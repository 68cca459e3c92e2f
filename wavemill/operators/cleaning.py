"""Cleaning of bars: filters, and the whole chain with the reason why each bar goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REQUIRED = ("bar_ts", "open", "high", "low", "close", "volume", "symbol", "interval")
PRICES = ("open", "high", "low", "close")
KEY = ("symbol", "interval", "bar_ts")


def is_missing(df: DataFrame) -> Column:
    out = F.lit(False)
    for c in REQUIRED:
        out = out | F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
    return out


def drop_missing(df: DataFrame) -> DataFrame:
    return df.where(~is_missing(df))


def valid_datetime(df: DataFrame, as_of: str) -> DataFrame:
    """Times that parse, without zone, and not after as_of."""
    if dict(df.dtypes)["bar_ts"] == "string":
        df = df.withColumn("bar_ts", F.try_to_timestamp("bar_ts").cast("timestamp_ntz"))
    return df.where(F.col("bar_ts") <= F.lit(as_of).cast("timestamp_ntz"))


def dedup_bars(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """The first bar of each symbol, interval and time in ingest order."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order_cols))
    return df.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def bad_price() -> Column:
    return F.least(*PRICES) <= 0


def valid_prices(df: DataFrame, flag_over: float = 1e6) -> DataFrame:
    """Positive prices; extreme ones stay, flagged."""
    return df.where(~bad_price()).withColumn("extreme", F.greatest(*PRICES) > flag_over)


def valid_volume(df: DataFrame) -> DataFrame:
    return df.where("volume >= 0")


def bad_ohlc() -> Column:
    """The first way in which a bar's prices contradict each other, or null."""
    high_low = F.when(F.col("high") < F.col("low"), "high_below_low")
    return high_low.when(F.col("high") < F.greatest("open", "close"), "high_below_open_close").when(F.col("low") > F.least("open", "close"), "low_above_open_close")


def valid_ohlc(df: DataFrame) -> DataFrame:
    return df.where(bad_ohlc().isNull())


def drop_outliers(df: DataFrame, threshold: float = 10.0, order_cols: tuple[str, ...] = ("bar_ts",)) -> DataFrame:
    """Without bars whose close is off the symbol's previous close by more than the threshold, relatively."""
    before = F.lag("close").over(Window.partitionBy("symbol", "interval").orderBy(*order_cols))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.abs(F.col("close") / F.col("_before") - 1) <= threshold)).drop("_before")


def min_bars(df: DataFrame, n: int = 50) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("symbol", "interval"))).where(F.col("_n") >= n).drop("_n")


def with_reason(df: DataFrame, as_of: str, order_cols: list[str], threshold: float = 10.0, least: int = 50) -> DataFrame:
    """The bars with the first check, in cascade order, that each of them fails (null: none). Later checks see
    what earlier ones left. One shuffle by symbol and interval serves the three windows."""
    df = df.repartition("symbol", "interval")
    row = F.when(is_missing(df), "missing").when(F.col("bar_ts") > F.lit(as_of).cast("timestamp_ntz"), "datetime")
    df = df.withColumn("reason", row)
    ok = F.col("reason").isNull()
    first = F.row_number().over(Window.partitionBy(*KEY, ok).orderBy(*order_cols))
    df = df.withColumn("reason", F.when(~ok, F.col("reason")).when(first > 1, "duplicate").when(bad_price(), "price").when(F.col("volume") < 0, "volume").otherwise(bad_ohlc()))
    series = Window.partitionBy("symbol", "interval", ok)
    before = F.lag("close").over(series.orderBy("bar_ts"))
    df = df.withColumn("reason", F.when(~ok, F.col("reason")).when(F.abs(F.col("close") / before - 1) > threshold, "outlier"))
    return df.withColumn("reason", F.when(~ok, F.col("reason")).when(F.count("*").over(series) < least, "min_bars"))


def validate_bars(df: DataFrame, as_of: str, order_cols: list[str], threshold: float = 10.0, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """The clean bars, and a report: bars per reason and their percentage of all."""
    marked = with_reason(df, as_of, order_cols, threshold, least)
    report = marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    report = report.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row per reason
    return marked.where("reason is null").drop("reason"), report


def quality_report(df: DataFrame) -> DataFrame:
    """Per interval: rows, symbols, and shares of rows that are complete and valid."""
    pct = lambda c: 100 * F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    ok = bad_ohlc().isNull() & ~F.coalesce(F.isnull(F.col("open") + F.col("high") + F.col("low") + F.col("close")), F.lit(True))
    return df.groupBy("interval").agg(
        F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), pct(is_missing(df)).alias("missing_pct"), pct(ok).alias("valid_ohlc_pct"), pct(F.least(*PRICES) > 0).alias("positive_price_pct"),
        pct(F.col("volume") >= 0).alias("valid_volume_pct"), (F.count("*") / F.countDistinct("symbol")).alias("bars_per_symbol"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"),
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows and symbols per category and interval."""
    return df.groupBy("source_category", "interval").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"))
