"""Streams with state, against the batch operators."""

import random

from pyspark.sql import functions as F

from wavemill.operators import cleaning as K
from wavemill.streaming.state import first_bars_stream


def test_duplicates_and_outliers_with_state(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for symbol in ("a", "b"):
        for hour in range(60):
            close = 10.0 + hour + (5000 if hour in (20, 41) else 0)
            for again in range(rng.choice([1, 1, 2, 3])):
                rows.append((symbol, "1h", f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00", close + again * 100_000, len(rows)))
    df = spark.createDataFrame(rows, "symbol string, interval string, bar_ts string, close double, ingest long").withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low")}).withColumn("volume", F.lit(1.0))
    whole = K.drop_outliers(K.dedup_bars(df, ["ingest"]), 10)
    parts = [df.where(f"hour(bar_ts) + 24 * (day(bar_ts) - 1) between {a} and {a + 19}") for a in (0, 20, 40)]
    for i, part in enumerate(parts):  # a micro-batch a file
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = first_bars_stream(stream, 10, "30 hours", 30 * 3_600_000).writeStream.format("memory").queryName("first_bars").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    cols = ["symbol", "bar_ts", "close"]
    got = sorted(map(tuple, spark.table("first_bars").select(cols).collect()))
    assert got == sorted(map(tuple, whole.select(cols).collect())) and 100 < len(got) < 120
