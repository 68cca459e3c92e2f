"""Swings and monowaves.

first_swing and next_swing are window expressions and joins; monowaves chase pointers, for short series over numpy
arrays in a grouped map, for long ones block by block (see skyline). An edge says that from bar s, in a direction
and with a number of skips, a monowave ends at bar e; need_idx is the last bar that must be known for
the edge to hold, so that one edge table serves every window of the series. turn is the first bar from e on that
goes beyond the edge's end value (the series' length if none does).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .skyline import BLOCK, edges, first_later, later_bars, run_ends, spans

SERIES = ("symbol", "interval")
EDGE = "symbol string, interval string, s int, up boolean, skip int, e int, low double, high double, need_idx int, turn int"


def with_runs(bars: DataFrame) -> DataFrame:
    """Adds rise_end and fall_end: where the strictly rising highs (falling lows) that hold the bar end."""
    w = Window.partitionBy(*SERIES).orderBy("bar_idx")
    cut = lambda stop: F.sum(F.when(stop, 1).otherwise(0)).over(w)
    marked = bars.withColumns({"_rise": cut(F.col("high") <= F.lag("high").over(w)), "_fall": cut(F.col("low") >= F.lag("low").over(w))})
    end = lambda run: F.max("bar_idx").over(Window.partitionBy(*SERIES, run))
    return marked.withColumns({"rise_end": end("_rise"), "fall_end": end("_fall")}).drop("_rise", "_fall")


def first_swing(bars: DataFrame, direction: str = "up") -> DataFrame:
    """The swing from each bar s: its end e and value. Up starts at the bar's low and climbs while highs rise
    strictly; it has zero length (value low[s]) if the next high does not exceed low[s]. Down is the mirror."""
    w = Window.partitionBy(*SERIES).orderBy("bar_idx")
    up = direction == "up"
    value, start, run = ("high", "low", "rise_end") if up else ("low", "high", "fall_end")
    ahead = F.lead(value).over(w)
    moves = ahead > F.col(start) if up else ahead < F.col(start)
    end = F.when(moves, F.lead(run).over(w)).otherwise(F.col("bar_idx"))
    found = with_runs(bars).withColumn("e", end).select(*SERIES, F.col("bar_idx").alias("s"), "e", F.col(start).alias("start_value"))
    at = bars.select(*SERIES, F.col("bar_idx").alias("e"), F.col(value).alias("_v"))
    return found.join(at, [*SERIES, "e"]).select(*SERIES, "s", "e", F.when(F.col("e") == F.col("s"), F.col("start_value")).otherwise(F.col("_v")).alias("value"))


def swings(low: np.ndarray, high: np.ndarray, up: bool, max_skip: int, strict: bool = False) -> dict[str, np.ndarray]:
    """s, skip, e, value (at the end), need_idx and turn of one series' edges, by skip, all bars at once. Down is up on mirrored
    prices, with its guard."""
    lo, hi = (low, high) if up else (-high, -low)
    n = len(hi)
    if not n:
        return {c: np.zeros(0, np.int64) for c in ("s", "skip", "e", "value", "need_idx", "turn")}
    tops = spans(hi)
    run_end, greater, not_less, reach = run_ends(hi), first_later(tops, hi, True), first_later(tops, hi, False), first_later(tops, lo, False)
    below = first_later(spans(-lo), -lo, True)  # the first later bar with a lower low: what the guard asks for
    at = lambda x, i: x[np.minimum(i, n - 1)]
    s = np.arange(n)
    moves = np.r_[hi[1:] > lo[:-1], False]
    e = np.where(moves, at(run_end, s + 1), s)
    need, out = e, [(s, np.zeros(n, np.int64), e, e)]
    for skip in range(1, max_skip + 1):
        zero = e == s
        value, j = np.where(zero, lo[e], hi[e]), np.where(zero, reach[e], not_less[e])
        equal = (j < n) & (at(hi, j) == value)
        # the first equal bar sets the level, the next one that is no lower decides; at once from a low or a flat bar
        later = equal & ~zero & (value != lo[e])
        j = np.where(later, at(not_less, j), j)
        known = j < n
        stall = equal & known & (at(hi, j) == value)
        end = np.where(stall, e, at(run_end, j))
        progress = known & ~stall & (end + 1 < n)
        if strict or not up:
            progress &= below[s] >= end
        some = stall | progress
        s, need, e = s[some], np.maximum(need, np.where(stall, j, end + 1))[some], end[some]
        out.append((s, np.full(len(s), skip), e, need))
    s, skip, e, need = (np.concatenate(x) for x in zip(*out, strict=True))
    value = np.where(e > s, hi[e], lo[s])
    return {"s": s, "skip": skip, "e": e, "value": value if up else -value, "need_idx": need, "turn": np.where(hi[e] > value, e, greater[e])}


def kernel(low: np.ndarray, high: np.ndarray, up: bool, max_skip: int, strict: bool = False) -> list[tuple[int, int, int, float, int]]:
    """swings as (s, skip, e, value, need_idx)."""
    found = swings(low, high, up, max_skip, strict)
    return list(zip(*(found[c].tolist() for c in ("s", "skip", "e", "value", "need_idx")), strict=True))


def monowaves(bars: DataFrame, max_skip: int, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Edges of both directions with 0 to max_skip skips; missing where a step finds no end. Down waves end where
    a bar before their end exceeds their start; up waves only if strict. A series of up to block bars is one task's array;
    if any is longer, all go block by block, with the same edges."""
    if (bars.groupBy(*SERIES).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > block:
        return edges(bars, max_skip, strict, block)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_idx")
        low, high = part["low"].to_numpy(float), part["high"].to_numpy(float)
        out = []
        for up in (True, False):
            found = pd.DataFrame(swings(low, high, up, max_skip, strict))
            start, value = (low if up else high)[found["s"]], found["value"].to_numpy(float)
            found["up"], found["low"], found["high"] = up, *((start, value) if up else (value, start))
            out.append(found)
        every = pd.concat(out)
        every["symbol"], every["interval"] = part["symbol"].iloc[0], part["interval"].iloc[0]
        return every[[c.split()[0] for c in EDGE.split(", ")]]

    return bars.select(*SERIES, "bar_idx", "low", "high").groupBy(*SERIES).applyInPandas(run, EDGE)


def next_swing(bars: DataFrame, direction: str = "up", block: int = BLOCK) -> DataFrame:
    """The next swing beyond each bar's first swing (skip 1 of an up or a down wave, whatever lies between): e and
    value, with progress false for a stall; no row where the series ends first. A check of the kernel by joins:
    what comes next is looked up by bar, from the next bars that reach its high and its low."""
    up = direction == "up"
    if not up:  # the mirror
        bars = bars.withColumns({"low": -F.col("high"), "high": -F.col("low")})
    first = first_swing(bars).withColumnsRenamed({"e": "e0", "value": "v0"})
    at = bars.select(*SERIES, "bar_idx", "low", "high")
    by_series = Window.partitionBy(*SERIES)
    marked = at.join(reached(at, block), [*SERIES, "bar_idx"])
    runs = with_runs(bars).select(*SERIES, "bar_idx", F.col("rise_end").alias("end"), F.max("bar_idx").over(by_series).alias("last"))
    look = lambda name, cols: marked.join(runs, [*SERIES, "bar_idx"]).select(*SERIES, F.col("bar_idx").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])
    got = first.join(look("e0", ["low", "of_high", "of_low"]), [*SERIES, "e0"])
    at_start = F.col("e0") == F.col("s")
    got = got.withColumn("j", F.when(at_start, F.col("e0_of_low")).otherwise(F.col("e0_of_high"))).where("j is not null")
    got = got.join(look("j", ["high", "end", "last", "of_high"]), [*SERIES, "j"])
    equal, at_once = F.col("j_high") == F.col("v0"), at_start | (F.col("v0") == F.col("e0_low"))
    got = got.withColumn("k", F.when(equal & ~at_once, F.col("j_of_high"))).where(F.col("k").isNotNull() | ~equal | at_once)
    got = got.join(look("k", ["high", "end"]), [*SERIES, "k"], "left")
    stall = equal & (at_once | (F.col("k_high") == F.col("v0")))
    end = F.when(F.col("k").isNotNull(), F.col("k_end")).otherwise(F.col("j_end"))
    got = got.withColumns({"stall": F.coalesce(stall, F.lit(False)), "end": end}).where("stall or end < j_last")
    tops = at.select(*SERIES, F.col("bar_idx").alias("end"), F.col("high").alias("top"))
    got = got.join(tops, [*SERIES, "end"])
    value = F.when(F.col("stall"), F.col("v0")).otherwise(F.col("top"))
    return got.select(*SERIES, "s", F.when(F.col("stall"), F.col("e0")).otherwise(F.col("end")).alias("e"), (value if up else -value).alias("value"), (~F.col("stall")).alias("progress"))


def reached(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """of_high and of_low of each bar: the first later bar whose high is no lower than its high, and than its low (null if
    none), block by block."""
    found = later_bars(bars, block).where("up")
    return found.select(*SERIES, F.col("i").alias("bar_idx"), F.col("not_less").alias("of_high"), F.col("reach").alias("of_low"))
