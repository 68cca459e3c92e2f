"""Cleaning of streams that needs other bars: keep-first duplicates and outliers, with state per series.

The state of a series holds the closes of its recent bars by time: those that a late bar may still meet (the watermark's
delay), and the last one before them. Timers drop what the watermark has passed, so the state is bounded by the delay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ("open", "high", "low", "close", "volume")


class FirstBars(StatefulProcessor):
    """Keeps the first bar of each time and drops those that move by more than the threshold from the bar before them."""

    def __init__(self, threshold: float, delay_ms: int):
        self.threshold, self.delay = threshold, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closes = handle.getMapState("closes", "ts long", "close double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: v[0] for k, v in self.closes.iterator()}
        batch = pd.concat(list(rows)).sort_values(["ms", "ingest"], kind="stable")  # of a batch, first in time, then in order of arrival
        keep = []
        for ts, close in zip(batch["ms"].tolist(), batch["close"].tolist(), strict=True):
            if ts in known:
                keep.append(False)
                continue
            before = max((t for t in known if t < ts), default=None)
            keep.append(before is None or not abs(close / known[before] - 1) > self.threshold)
            known[ts] = close
            self.closes.updateValue((ts,), (close,))
            self.handle.registerTimer(ts + self.delay)
        out = batch[keep]
        yield out.assign(symbol=key[0], interval=key[1])[["symbol", "interval", "bar_ts", *COLUMNS]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        old = sorted(k[0] for k, _ in self.closes.iterator() if k[0] + self.delay <= passed)
        for ts in old[:-1]:  # the last one is what the next bar is compared with
            self.closes.removeKey((ts,))
        yield pd.DataFrame(columns=["symbol", "interval", "bar_ts", *COLUMNS])

    def close(self) -> None:
        pass


def first_bars_stream(bars: DataFrame, threshold: float = 10.0, delay: str = "1 hour", delay_ms: int = 3_600_000) -> DataFrame:
    """symbol, interval, bar_ts and prices of a stream of bars (with ingest, the order of arrival): of bars of one time the first,
    without outliers. A bar is compared with the latest known one before it, also if that was an outlier itself, as in
    batch; later bars that have gone out are not judged again by a late one."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = bars.select("symbol", "interval", F.col("bar_ts").cast("timestamp").alias("bar_ts"), *COLUMNS, "ingest", F.unix_millis(F.col("bar_ts").cast("timestamp")).alias("ms")).withWatermark("bar_ts", delay)
    schema = "symbol string, interval string, bar_ts timestamp, " + ", ".join(f"{c} double" for c in COLUMNS)
    found = timed.groupBy("symbol", "interval").transformWithStateInPandas(FirstBars(threshold, delay_ms), schema, "Append", "EventTime")
    return found.withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
