"""Cleaning and resampling of bars that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import bad_ohlc, bad_price, is_missing
from ..operators.resample import resample_bars


def clean_stream(bars: DataFrame) -> DataFrame:
    """The checks that need no other bar: complete, positive prices, no negative volume, consistent prices."""
    return bars.where(~is_missing(bars) & ~bad_price() & (F.col("volume") >= 0) & bad_ohlc().isNull())


def resample_stream(bars: DataFrame, width: str, interval: str, late: str = "1 hour") -> DataFrame:
    """Tumbling bars of a stream; bars later than the watermark are not taken up."""
    timed = bars.withColumn("bar_ts", F.col("bar_ts").cast("timestamp")).withWatermark("bar_ts", late)  # a watermark needs a zoned time
    return resample_bars(timed, width, interval).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
