"""Intermediate results that are read more than once."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = ("symbol", "interval")
#: Rows of a bucket of series, and bars of a series up to which all of it may be one bucket's.
ROWS, LONGEST = 500_000, 4096
#: Rows of a kept table up to which Spark may broadcast it.
BROADCAST_ROWS = 20_000
#: Set to false, joins on series and more take tables that are dealt by series as they are.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def new_folder(spark: SparkSession) -> str:
    """A name for a folder of its own in the shared folder: spark.checkpoint.dir, or where that is unset and all work is done on
    this machine, one in the warehouse. A cluster has to name its folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kept"
    return f"{folder}/kept-{uuid.uuid4()}"


def buckets_for(rows: DataFrame) -> int:
    """How many buckets a table with about as many rows is dealt to: the more rows, the more, so that none outgrows a task."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)


def short_series(bars: DataFrame) -> bool:
    """Whether each series is short enough for one task."""
    return (bars.groupBy(*SERIES).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= LONGEST


def merged(table: DataFrame) -> DataFrame:
    """The table, for joins that sort and merge it if it has more than BROADCAST_ROWS rows. Left to itself, Spark broadcasts what
    has small files, and those of a kept table may be a two-hundredth of what its rows take on the driver. Not for joins by
    series alone of series that are too long for one task."""
    return table.hint("merge") if table.count() > BROADCAST_ROWS else table


def kept(df: DataFrame, buckets: int | None = None, dealt: bool = False, merge: bool = True) -> DataFrame:
    """The rows as a table in the shared folder, for later plans to know its size and lost executors to read it again. With
    buckets, it is dealt by symbol to so many: what is worked out from such tables by series, or by series and more, and
    kept in as many buckets again, needs no exchange. That is for short series only, as a symbol is one task's then. dealt:
    the rows come from maps over series of such a table, so that each task has one bucket's, though the plan can't tell.
    Tables in buckets are merged in joins unless merge is false."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    if buckets is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name, before = f"kept_{uuid.uuid4().hex}", spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        rows = df if dealt else df.repartition(buckets, "symbol")  # no exchange if the plan deals them so
        rows.write.option("path", path).bucketBy(buckets, "symbol").saveAsTable(name)
    finally:
        spark.conf.set(CO_PARTITION, before)
    return merged(spark.table(name)) if merge else spark.table(name)
