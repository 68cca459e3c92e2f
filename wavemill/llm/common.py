"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python; the default is counted in rows, whatever their size.
BATCH_BYTES = "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on its session sends them to Python in batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks and share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty; other columns, whatever their names, stay out."""
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Views of the batches with about max_bytes of the column each (one row at least), so that what
    a task holds besides its Arrow batch does not depend on the batch's row count."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        block = (np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) - 1) // max_bytes
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def shared_dir(spark: SparkSession) -> str:
    """Makes sure that checkpoint() has a folder: the cluster's spark.checkpoint.dir, or where that
    is unset (tests on one machine) a folder in the warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The same rows, from a compressed table in the shared folder: computed once, without lineage."""
    folder = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Tasks that the rows of one key are spread over where rows and not the table are many.
SALTS = 16


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], how: str, small: bool) -> DataFrame:
    """Joins rows (left) with a table that has each key once. A small table is broadcast and no row moves; otherwise both
    are shuffled, and the rows of a hot key are spread over SALTS tasks by where they are read."""
    if small:
        return rows.join(F.broadcast(table), on, how)
    salt = "salt"
    while salt in rows.columns or salt in table.columns:
        salt += "_"
    rows = rows.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    table = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(table, [*on, salt], how).drop(salt)
