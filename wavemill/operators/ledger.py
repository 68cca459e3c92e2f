"""Runs that are committed once: results are staged under an attempt of their own, and a ledger row, with the run's
statistics, makes one attempt of a run visible. A commit that is repeated, or was lost half way and tried again, changes
nothing that readers see: they take the attempts that the ledger names, and rows of other attempts are as if not there."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = ("symbol", "interval")
STATS = "series long, done long, failed long, patterns long, per_series double, best_score double, mean_score double"
LEDGER = f"run_id string, attempt string, {STATS}, hits_schema string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A row for each committed run: run_id, attempt, statistics."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{path}/ledger")


def stage(result: DataFrame, path: str, run_id: str, series: DataFrame | None = None) -> str:
    """Writes a run's hits, its failures and what became of its series under a new attempt, whose name it returns. A failed
    series comes again, so its hits wait for that run. series: all that the run was to scan, those without hits, too."""
    attempt = uuid.uuid4().hex
    failures = result.where("error is not null").select(*SERIES, "error")
    hits = result.where("error is null").join(failures.select(*SERIES), list(SERIES), "left_anti").select(result.columns)
    every = (result if series is None else series).select(*SERIES).distinct()
    status = every.join(failures.select(*SERIES).distinct().withColumn("failed", F.lit(True)), list(SERIES), "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    for name, rows in (("hits", hits), ("failures", failures), ("series", status)):
        rows.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)}).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/{name}")
    return attempt


def staged(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, run_id string, attempt string").parquet(f"{path}/{name}")


def commit_run(result: DataFrame, path: str, run_id: str, series: DataFrame | None = None) -> DataFrame:
    """Stages a run and enters it in the ledger, unless that has it already; returns its ledger row."""
    spark = result.sparkSession
    mine = F.col("run_id") == run_id
    if not ledger(spark, path).where(mine).limit(1).count():
        attempt = stage(result, path, run_id, series)
        schema = ", ".join(f"`{c}` {t}" for c, t in result.dtypes)
        here = mine & (F.col("attempt") == attempt)
        hits = staged(spark, path, "hits", schema).where(here).agg(F.count("*").alias("patterns"), F.max("ensemble_score").alias("best_score"), F.avg("ensemble_score").alias("mean_score"))
        status = staged(spark, path, "series", "symbol string, interval string, failed boolean").where(here)
        status = status.agg(F.count("*").alias("series"), F.count_if(~F.col("failed")).alias("done"), F.count_if("failed").alias("failed"))
        row = status.join(hits).withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt), "hits_schema": F.lit(schema), "per_series": F.try_divide(F.col("patterns").cast("double"), F.col("done").cast("double"))})  # two rows of one
        row = row.select(*[c.split()[0] for c in LEDGER.split(", ")])
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{quote(run_id, safe='')}")
    return ledger(spark, path).where(mine)


def committed(spark: SparkSession, path: str, name: str = "hits") -> DataFrame:
    """The rows of committed runs: hits, failures or series."""
    runs = ledger(spark, path)
    schemas = {"failures": "symbol string, interval string, error string", "series": "symbol string, interval string, failed boolean"}
    if name == "hits":
        first = runs.select("hits_schema").limit(1).collect()
        if not first:
            raise ValueError(f"no run is committed in {path}")
        schemas["hits"] = first[0].hits_schema
    if not runs.limit(1).count():
        return spark.createDataFrame([], f"{schemas[name]}, run_id string, attempt string")
    return staged(spark, path, name, schemas[name]).join(runs.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")


def done_series(spark: SparkSession, path: str) -> DataFrame:
    """The series that some committed run has scanned without an error."""
    return committed(spark, path, "series").where("not failed").select(*SERIES).distinct()
