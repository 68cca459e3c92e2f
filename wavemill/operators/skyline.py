"""What each bar finds first among the later bars of its series, block by block.

A series is cut into blocks of bars. Inside a block, the first later bar that reaches a price is found for all bars at
once, by halving steps over the greatest highs of spans of powers of two bars. What a block cannot answer asks the
blocks after it: the same halving over the blocks' greatest highs, by joins, finds the first block that reaches the
price, and there the bar is one of the block's skyline (bars higher than all before them in the block). So the bars
of one long series are spread over tasks, and no task holds more than a block. Each direction is a side; the down side has
mirrored prices (lo = -high, hi = -low)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import kept

SERIES = ("symbol", "interval")
SIDE = (*SERIES, "up")
#: Bars of a block.
BLOCK = 4096
KINDS = ("greater", "not_less", "reach")


def first_later(tops: np.ndarray, x: np.ndarray, strict: bool) -> np.ndarray:
    """For each bar i, the first later bar whose high is greater than x[i] (not less, if not strict); n if there is none."""
    n = tops.shape[1]
    pos = np.arange(1, n + 1)
    for level in range(len(tops) - 1, -1, -1):
        span = 1 << level
        top = tops[level, np.minimum(pos, n - span)] if span <= n else np.full(n, np.inf)
        pos = pos + span * ((pos + span <= n) & ((top <= x) if strict else (top < x)))
    return pos


def spans(high: np.ndarray) -> np.ndarray:
    """The greatest high of the 2^level bars from each bar on, for each level."""
    out = [high]
    for level in range(1, max(1, len(high)).bit_length()):
        half = 1 << (level - 1)
        out.append(np.concatenate([np.maximum(out[-1][:-half], out[-1][half:]), out[-1][-half:]]))
    return np.array(out)


def run_ends(high: np.ndarray) -> np.ndarray:
    """Where the strictly rising run that holds each bar ends."""
    n = len(high)
    stops = np.r_[np.flatnonzero(high[1:] <= high[:-1]), n - 1] if n else np.zeros(0, np.int64)
    return stops[np.searchsorted(stops, np.arange(n))]


def sides(bars: DataFrame) -> DataFrame:
    up = bars.select(*SERIES, F.lit(True).alias("up"), F.col("bar_idx").alias("i"), F.col("low").cast("double").alias("lo"), F.col("high").cast("double").alias("hi"))
    return up.unionByName(up.select(*SERIES, F.lit(False).alias("up"), "i", (-F.col("hi")).alias("lo"), (-F.col("lo")).alias("hi")))


def inside(rows: DataFrame, block: int) -> DataFrame:
    """The sides' bars with what their own block answers (null: not in this block)."""
    schema = "symbol string, interval string, up boolean, block int, i int, lo double, hi double, run_end int, greater int, not_less int, reach int, before double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, lo, hi = (table[c].to_numpy() for c in ("i", "lo", "hi"))
        n, tops = len(i), spans(hi)
        found = [run_ends(hi), first_later(tops, hi, True), first_later(tops, hi, False), first_later(tops, lo, False)]
        found[0] = np.where(found[0] == n - 1, n, found[0])  # the next bar is another block's
        found = [pa.array(i[np.minimum(x, n - 1)], pa.int32(), mask=x == n) for x in found]
        top = np.r_[-np.inf, np.maximum.accumulate(hi)[:-1]]
        before = pa.array(top, mask=hi <= top)
        return pa.table([*(table[c] for c in (*SIDE, "block", "i", "lo", "hi")), *found, before], names=[c.split()[0] for c in schema.split(", ")])

    rows = rows.withColumn("block", F.floor(F.col("i") / block).cast("int")).select(*SIDE, "block", F.col("i").cast("int").alias("i"), "lo", "hi")
    return rows.groupBy(*SIDE, "block").applyInArrow(run, schema)


def later_bars(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """SIDE, i, lo, hi, last (the series' last bar), run_end, and the first later bars with a greater high, with one not less,
    and with a high not less than the low (reach), null where there is none."""
    own = kept(inside(sides(bars), block))
    first = F.struct("i", "hi")
    blocks = own.groupBy(*SIDE, "block").agg(F.max("hi").alias("top"), F.min(first)["hi"].alias("first_hi"), F.max(first)["hi"].alias("last_hi"), F.max("i").alias("end"), F.min("run_end").alias("stop"))
    along = Window.partitionBy(*SIDE).orderBy("block")  # a row a block
    ends_here = ~F.coalesce(F.lead("first_hi").over(along) > F.col("last_hi"), F.lit(False))
    blocks = blocks.withColumn("_own", F.when(ends_here, F.col("end"))).withColumn("_stop", F.coalesce("stop", "_own"))
    blocks = blocks.withColumn("carried", F.coalesce("_own", F.first("_stop", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))))
    blocks = kept(blocks.withColumn("last", F.max("end").over(Window.partitionBy(*SIDE))).drop("_own", "_stop"))
    whole = own.join(blocks.select(*SIDE, "block", "carried", "last"), [*SIDE, "block"]).withColumn("run_end", F.coalesce("run_end", "carried")).drop("carried")
    levels = (blocks.agg(F.max("block")).first()[0] or 0).bit_length()
    if not levels:
        return whole.drop("block", "before")

    open_ = whole.where(F.col("block") < F.floor(F.col("last") / block))
    asked = F.inline(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("lo" if k == "reach" else "hi").alias("x"), F.lit(k == "greater").alias("strict"), F.col(k).alias("_got")) for k in KINDS]), lambda q: q["_got"].isNull()))
    asks = open_.select(*SIDE, F.col("i").alias("asker"), (F.col("block") + 1).alias("block"), asked).drop("_got")
    tops = blocks.select(*SIDE, "block", F.col("top").alias("_t0"))
    for level in range(1, levels):
        tops = tops.withColumn(f"_t{level}", F.greatest(f"_t{level - 1}", F.lead(f"_t{level - 1}", 1 << (level - 1)).over(along)))
    tops = kept(tops)
    for level in range(levels - 1, -1, -1):
        asks = asks.join(tops.select(*SIDE, "block", F.col(f"_t{level}").alias("_top")), [*SIDE, "block"], "left")
        below = (F.col("_top") < F.col("x")) | F.col("strict") & (F.col("_top") == F.col("x"))
        asks = asks.withColumn("block", F.when(below, F.col("block") + (1 << level)).otherwise(F.col("block"))).drop("_top")
    skyline = own.where("before is not null").select(*SIDE, "block", F.col("i").alias("j"), "hi", "before")
    passed = (F.col("before") < F.col("x")) | F.col("strict") & (F.col("before") == F.col("x"))
    reaches = (F.col("hi") > F.col("x")) | ~F.col("strict") & (F.col("hi") == F.col("x"))
    found = asks.join(skyline, [*SIDE, "block"]).where(passed & reaches)  # one bar of the skyline for each
    found = found.groupBy(*SIDE, F.col("asker").alias("i")).agg(*[F.max(F.when(F.col("kind") == k, F.col("j"))).alias(f"_{k}") for k in KINDS])
    both = whole.join(found, [*SIDE, "i"], "left")
    return both.select(*SIDE, "i", "lo", "hi", "last", "run_end", *[F.coalesce(k, f"_{k}").alias(k) for k in KINDS])


def steps(later: DataFrame) -> DataFrame:
    """What follows a swing that ended at e, from the bar's own low (a zero-length swing: s_ columns) or its high (n_): end,
    need (the deciding bar) and stall; nulls where it needs bars that do not exist."""
    at = lambda name: later.select(*SIDE, F.col("i").alias(name), F.col("hi").alias(f"{name}_hi"), F.col("run_end").alias(f"{name}_end"), F.col("not_less").alias(f"{name}_then"))
    t = later.withColumnsRenamed({"reach": "r", "not_less": "j", "i": "e"})
    t = t.join(at("r"), [*SIDE, "r"], "left").join(at("j"), [*SIDE, "j"], "left")
    equal, flat = F.col("j_hi") == F.col("hi"), F.col("hi") == F.col("lo")
    t = t.withColumn("k", F.when(equal & ~flat, F.col("j_then"))).join(at("k"), [*SIDE, "k"], "left")

    def step(stall: Column, deciding: Column, end: Column) -> Column:
        end_, need = F.when(stall, F.col("e")).otherwise(end), F.when(stall, deciding).otherwise(end + 1)
        return F.when(stall | (end < F.col("last")), F.struct(end_.alias("end"), need.alias("need"), stall.alias("stall")))

    from_low = step(F.col("r_hi") == F.col("lo"), F.col("r"), F.col("r_end"))
    # an equal bar stalls a flat one at once; else the one after it that is no lower decides
    from_high = F.when(equal & ~flat, step(F.col("k_hi") == F.col("hi"), F.col("k"), F.col("k_end"))).otherwise(step(equal, F.col("j"), F.col("j_end")))
    return t.select(*SIDE, "e", from_low.alias("from_low"), from_high.alias("from_high"))


def edges(bars: DataFrame, max_skip: int, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """The edges of swings.monowaves by joins: each skip looks the next step of all bars up."""
    later = kept(later_bars(bars, block))
    step = kept(steps(later))
    ahead = later.select(*SIDE, (F.col("i") - 1).alias("s"), F.col("hi").alias("_hi"), F.col("run_end").alias("_end"))
    guard = later.select(*SERIES, (~F.col("up")).alias("up"), F.col("i").alias("s"), F.col("greater").alias("_below"))  # a lower low is the other side's greater high
    e = F.when(F.col("_hi") > F.col("lo"), F.col("_end")).otherwise(F.col("s"))
    state = later.select(*SIDE, F.col("i").alias("s"), "lo").join(ahead, [*SIDE, "s"], "left").join(guard, [*SIDE, "s"], "left")
    state = state.withColumn("e", e).withColumn("need", F.col("e")).drop("_hi", "_end", "lo")
    one = lambda skip: F.array(F.struct(F.lit(skip).alias("skip"), "e", F.col("need").alias("need_idx")))
    state = state.withColumn("_found", one(0))
    for skip in range(1, max_skip + 1):
        met = state.join(step, [*SIDE, "e"], "left")
        taken = F.when(F.col("e") == F.col("s"), F.col("from_low")).otherwise(F.col("from_high"))
        end = taken["end"]
        broken = ~taken["stall"] & (F.col("_below") < end) & (F.lit(strict) | ~F.col("up"))
        goes_on = taken.isNotNull() & ~F.coalesce(broken, F.lit(False))
        state = met.select(*SIDE, "s", "_below", "_found", F.when(goes_on, end).alias("e"), F.when(goes_on, F.greatest("need", taken["need"])).alias("need"))
        state = state.withColumn("_found", F.when(F.col("e").isNotNull(), F.concat("_found", one(skip))).otherwise(F.col("_found")))
    every = state.select(*SIDE, "s", F.inline("_found"))
    start = later.select(*SIDE, F.col("i").alias("s"), F.col("lo").alias("_lo"))
    top = later.select(*SIDE, F.col("i").alias("e"), F.col("hi").alias("_hi"), F.coalesce("greater", F.col("last") + 1).alias("_turn"))
    every = every.join(start, [*SIDE, "s"]).join(top, [*SIDE, "e"])
    value = F.when(F.col("e") > F.col("s"), F.col("_hi")).otherwise(F.col("_lo"))
    turn = F.when(F.col("_hi") > value, F.col("e")).otherwise(F.col("_turn"))
    return every.select(
        *SERIES, "s", "up", "skip", "e", F.when(F.col("up"), F.col("_lo")).otherwise(-value).alias("low"), F.when(F.col("up"), value).otherwise(-F.col("_lo")).alias("high"), "need_idx", turn.cast("int").alias("turn"),
    )
