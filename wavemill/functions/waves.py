"""The wave struct and what is measured on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WAVE = "struct<label:string,idx_start:int,idx_end:int,low:double,high:double,low_idx:int,high_idx:int,length:double,duration:int>"


def wave_struct(label: str, up: bool, start: Column, end: Column, low: Column, high: Column) -> Column:
    """A monowave from its ends: length is the price range, duration the bars between."""
    return F.struct(
        F.lit(label).alias("label"), start.cast("int").alias("idx_start"), end.cast("int").alias("idx_end"), low.alias("low"), high.alias("high"),
        (start if up else end).cast("int").alias("low_idx"), (end if up else start).cast("int").alias("high_idx"),
        F.abs(high - low).alias("length"), (end - start).cast("int").alias("duration"),
    )


def roll_up(waves: Column, degree: Column | int = 1) -> Column:
    """A complete pattern of five or three waves as one monowave of the next degree: from the first wave's low
    to the fifth's high, or from the first's high to the third's low."""
    first, last, five = waves[0], F.element_at(waves, -1), F.size(waves) == 5
    low, high = F.when(five, first["low"]).otherwise(last["low"]), F.when(five, last["high"]).otherwise(first["high"])
    return F.struct(
        first["idx_start"].alias("idx_start"), last["idx_end"].alias("idx_end"), low.alias("low"), high.alias("high"), F.abs(high - low).alias("length"),
        (last["idx_end"] - first["idx_start"]).alias("duration"), ((F.lit(degree) if isinstance(degree, int) else degree) + 1).alias("degree"),
    )


def polyline(waves: Column) -> Column:
    """The pattern's vertices (idx, value, label); on labels B, 2 and 3 with the wave's length over the first's."""
    first = waves[0]
    up = first["low_idx"] == first["idx_start"]
    begin = F.struct(first["idx_start"].alias("idx"), F.when(up, first["low"]).otherwise(first["high"]).alias("value"), F.lit("").alias("label"), F.lit(None).cast("double").alias("ratio"))

    def vertex(w: Column) -> Column:
        value = F.when(w["high_idx"] > w["low_idx"], w["high"]).when(w["high_idx"] < w["low_idx"], w["low"]).otherwise(w["low"])
        ratio = F.when(w["label"].isin("B", "2", "3") & (first["length"] > 0), F.round(w["length"] / first["length"], 3))
        return F.struct(w["idx_end"].alias("idx"), value.alias("value"), w["label"].alias("label"), ratio.alias("ratio"))

    return F.concat(F.array(begin), F.transform(waves, vertex))
