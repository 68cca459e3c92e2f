"""Walks along series whose next stop is a function of the stop, by pointer doubling: joins instead of a loop per series.

After k rounds a pointer leads 2^k stops on, so a walk of n stops takes log n rounds, each two equi-joins on (series,
stop) that spread the stops of one long series over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import nearest
from .tables import kept, merged


def visited(steps: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at and seen for each stop of the walks that begin at starts (keys, at, seen; one for each key) and follow
    steps (keys, at, then, cost); a null then ends a walk. seen adds up the costs."""
    jump = kept(steps.where("then is not null").select(*keys, "at", "then", F.col("cost").cast("long").alias("cost")))
    found = kept(starts.select(*keys, "at", F.col("seen").cast("long").alias("seen")))
    while jump.limit(1).count():
        jump = merged(jump)
        more = found.join(jump, [*keys, "at"]).select(*keys, F.col("then").alias("at"), (F.col("seen") + F.col("cost")).alias("seen"))
        ahead = jump.select(*keys, F.col("at").alias("then"), F.col("then").alias("_then"), F.col("cost").alias("_cost"))
        found = kept(found.union(more))
        jump = kept(jump.join(ahead, [*keys, "then"]).select(*keys, "at", F.col("_then").alias("then"), (F.col("cost") + F.col("_cost")).alias("cost")))
    return found


def next_stops(stops: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """asks (keys, pos and others) with then, the first stop (keys, at) of their keys at or after pos, null if there is none."""
    own = [c for c in asks.columns if c not in (*keys, "pos")]
    row = F.struct(*own) if own else F.struct(F.lit(0).alias("_none"))
    asked = asks.select(*keys, "pos", F.lit(0).alias("_stop"), row.alias("_row"), F.lit(None).cast(stops.schema["at"].dataType).alias("_at"))
    there = stops.select(*keys, F.col("at").alias("pos"), F.lit(1).alias("_stop"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col("at").alias("_at"))
    both = nearest(asked.unionByName(there), keys, ["pos", "_stop"], "_at").where("_stop = 0")
    return both.select(*keys, "pos", *[F.col("_row")[c].alias(c) for c in own], F.col("_ahead").alias("then"))
