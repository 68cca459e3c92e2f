"""Scans along ordered rows in range partitions: no window holds more than a piece of a key's rows. What a piece needs
to know of the others is carried over a table with a row per key and piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import kept, merged

FORWARD = (0, Window.unboundedFollowing)
BACKWARD = (Window.unboundedPreceding, 0)


def in_pieces(rows: DataFrame, *order: str) -> DataFrame:
    """The rows as a table, with _piece: pieces follow each other in the order and hold about equally many rows, and equal
    rows are in one piece. A table, as sampled ranges differ from run to run."""
    return kept(rows.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()))


def nearest(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds _ahead, the first value that is not null from each row on, and _behind, the last one up to it, along the order
    of each key. Within pieces by windows; what a piece lacks comes from the nearest piece of its key that has a value."""
    pieces = merged(in_pieces(rows, *keys, *order))
    w = Window.partitionBy("_piece", *keys).orderBy(*order)
    inside = pieces.withColumns({"_ahead": F.first(value, ignorenulls=True).over(w.rowsBetween(*FORWARD)), "_behind": F.last(value, ignorenulls=True).over(w.rowsBetween(*BACKWARD))})
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = pieces.groupBy(*keys, "_piece").agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_piece")  # a row a piece
    carried = ends.select(*keys, "_piece", F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_next"), F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    met = inside.join(carried, [*keys, "_piece"])
    return met.withColumns({"_ahead": F.coalesce("_ahead", "_next"), "_behind": F.coalesce("_behind", "_before")}).drop("_next", "_before", "_piece")


def running(rows: DataFrame, order: list[str], amount: Column) -> DataFrame:
    """Adds _sum, the sum of the amounts up to each row, and _top, the highest sum so far (0 before the first row). Pieces
    are summed up as (total, highest sum), which compose from left to right: (a, s) then (b, t) is (a + b, max(s, a + t))."""
    pieces = in_pieces(rows.withColumn("_amount", amount), *order)
    w = Window.partitionBy("_piece").orderBy(*order).rowsBetween(*BACKWARD)
    inside = pieces.withColumn("_sum", F.sum("_amount").over(w))
    ends = inside.groupBy("_piece").agg(F.sum("_amount").alias("_total"), F.max("_sum").alias("_best"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    ends = ends.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    ends = ends.withColumn("_top0", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("_offset") + F.col("_best")).over(before), F.lit(0.0))))
    met = inside.join(ends.select("_piece", "_offset", "_top0"), "_piece").withColumn("_sum", F.col("_offset") + F.col("_sum"))
    return met.withColumn("_top", F.greatest("_top0", F.max("_sum").over(w))).drop("_piece", "_amount", "_offset", "_top0")
