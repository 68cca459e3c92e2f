"""Scan windows over indexed bars, their starts and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import kept
from .walks import next_stops, visited

SERIES = ("symbol", "interval")
#: Bars of the shortest and longest window and of the slide, by profile and interval.
GEOMETRY = {
    "default": {"1h": (40, 200, 20), "4h": (40, 200, 20), "1d": (56, 728, 7), "1wk": (20, 104, 4)},
    "validated": {"1h": (40, 200, 20), "4h": (40, 200, 20), "1d": (30, 730, 7), "1wk": (20, 104, 4)},
    "hybrid": {"1h": (40, 200, 20), "1d": (40, 200, 10), "1wk": (20, 104, 4)},
}
BARS_PER_WEEK = {"1d": 7, "1wk": 1}
#: Bars of a stretch by which windows meet local lows.
SPAN = 64
#: Bars of a block within which local lows are told.
BLOCK = 4096


def window_config(spark: SparkSession, profile: str = "default") -> DataFrame:
    """interval, min_len, max_len, slide: a row per interval."""
    return spark.createDataFrame([(i, *g) for i, g in GEOMETRY[profile].items()], "interval string, min_len int, max_len int, slide int")


def sliding_windows(bars: DataFrame, geometry: DataFrame) -> DataFrame:
    """Windows on a fixed grid: a start every slide bars, as long as max_len or the series allow, min_len at least."""
    n = bars.groupBy(*SERIES).agg(F.count("*").cast("int").alias("n")).join(F.broadcast(geometry), "interval").where("n >= min_len")
    starts = n.withColumn("start_row", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("min_len"), F.col("slide"))))
    return starts.select(*SERIES, "start_row", F.least("max_len", F.col("n") - F.col("start_row")).alias("window_len"))


def adaptive_windows(bars: DataFrame, geometry: DataFrame, grow: int) -> DataFrame:
    """For each start on the grid, windows of min_len, min_len + grow, ... up to max_len and the series' end."""
    n = bars.groupBy(*SERIES).agg(F.count("*").cast("int").alias("n")).join(F.broadcast(geometry), "interval").where("n >= min_len")
    starts = n.withColumn("start_row", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("min_len"), F.col("slide"))))
    longest = F.least("max_len", F.col("n") - F.col("start_row"))
    return starts.select(*SERIES, "start_row", F.explode(F.sequence("min_len", longest, F.lit(grow))).alias("window_len"))


def first_hit(hits: DataFrame) -> DataFrame:
    """Of hits in growing windows, those of the shortest window of each start."""
    shortest = F.min("window_len").over(Window.partitionBy(*SERIES, "start_row"))
    return hits.withColumn("_shortest", shortest).where("window_len = _shortest").drop("_shortest")


def spaced(indices: Column, distance: int) -> Column:
    """The ascending indices that are at least distance after the last one taken."""
    step = lambda taken, i: F.when((F.size(taken) == 0) | (i - F.coalesce(F.try_element_at(taken, F.lit(-1)), F.lit(-(2**30))) >= distance), F.concat(taken, F.array(i))).otherwise(taken)
    return F.aggregate(indices, F.array().cast("array<int>"), step)


def low_starts(bars: DataFrame, k: int = 5, distance: int = 3, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """keys, start and lowest (a flag) of the bars whose low is the least of k bars to either side, spaced by distance, and
    of the first bar of the least low of all. Fewer than k bars: that one alone. Bars meet in blocks of BLOCK with k bars
    of their neighbours; the spacing, by which each low taken decides on the next, is a walk by pointer doubling."""
    series = list(keys)
    ends = bars.groupBy(*series).agg(F.max("bar_idx").alias("_last"), F.min_by("bar_idx", F.struct("low", "bar_idx")).alias("_at"))
    block = lambda i: F.floor(i / BLOCK)
    spread = bars.select(*series, "bar_idx", "low").withColumn("_block", F.explode(F.sequence(block(F.greatest(F.col("bar_idx") - k, F.lit(0))), block(F.col("bar_idx") + k))))
    around = Window.partitionBy(*series, "_block").orderBy("bar_idx").rowsBetween(-k, k)
    marked = spread.withColumn("_least", F.min("low").over(around)).where((F.col("_block") == block(F.col("bar_idx"))) & (F.col("low") == F.col("_least")))
    lows = marked.join(ends, series).where((F.col("bar_idx") >= k) & (F.col("bar_idx") <= F.col("_last") - k)).select(*series, F.col("bar_idx").alias("at"))
    if distance > 1:
        lows = kept(lows)
        steps = next_stops(lows, lows.select(*series, "at", (F.col("at") + distance).alias("pos")), series).withColumn("cost", F.lit(1))
        lows = visited(steps, lows.groupBy(*series).agg(F.min("at").alias("at")).withColumn("seen", F.lit(1)), series)
    taken = lows.select(*series, F.col("at").alias("start"), F.lit(False).alias("lowest"))
    return taken.unionByName(ends.select(*series, F.col("_at").alias("start"), F.lit(True).alias("lowest"))).groupBy(*series, "start").agg(F.max("lowest").alias("lowest"))


def local_lows(bars: DataFrame, k: int = 5, distance: int = 3, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """low_starts as an ascending list starts for each series, with lowest, the bar of the least low of all."""
    every = low_starts(bars, k, distance, keys).groupBy(*keys)
    return every.agg(F.array_sort(F.collect_list("start")).alias("starts"), F.max(F.when(F.col("lowest"), F.col("start"))).alias("lowest"))


def lowest_in(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds lowest, the first bar of the least low, to spans of bars (SERIES, first, last): the lower one of two
    spans of a power of two bars that cover it, whose lowest bars are found by doubling."""
    levels = max(0, (spans.agg(F.max(F.col("last") - F.col("first") + 1)).first()[0] or 1).bit_length())
    w = Window.partitionBy(*SERIES).orderBy("bar_idx")
    b = bars.select(*SERIES, "bar_idx", F.struct("low", "bar_idx").alias("_m0"))
    for p in range(1, levels):
        b = b.withColumn(f"_m{p}", F.least(f"_m{p - 1}", F.lead(f"_m{p - 1}", 1 << (p - 1)).over(w)))
    tops = F.array(*[f"_m{p}" for p in range(max(1, levels))])
    level = F.length(F.bin((F.col("last") - F.col("first") + 1).cast("long"))) - 1
    spans = spans.withColumn("_level", level).withColumn("_second", F.expr("cast(last - shiftleft(1, _level) + 1 as int)"))
    one = b.select(*SERIES, F.col("bar_idx").alias("first"), tops.alias("_a"))
    two = b.select(*SERIES, F.col("bar_idx").alias("_second"), tops.alias("_b"))
    found = spans.join(one, [*SERIES, "first"]).join(two, [*SERIES, "_second"])
    return found.withColumn("lowest", F.least(F.col("_a")[F.col("_level")], F.col("_b")[F.col("_level")])["bar_idx"]).drop("_a", "_b", "_level", "_second")


def window_starts(bars: DataFrame, windows: DataFrame, k: int = 5, distance: int = 10, most: int = 10) -> DataFrame:
    """start, last and extrema (of the lows from the start to the window's end), low_last and high_last for each start of
    each window (symbol, interval, start_row, window_len): local_lows and select_starts of the windows' own bars. Local
    lows are found once per series; a window meets those of its stretches of SPAN bars only."""
    series = Window.partitionBy(*SERIES).orderBy("bar_idx")
    step = F.signum(F.col("low") - F.lag("low").over(series))
    marked = bars.select(*SERIES, "bar_idx", "low", "high", step.alias("_d"), F.min("low").over(series.rowsBetween(-k, k)).alias("_least"))
    marked = marked.withColumn("_x", F.sum(F.when(F.col("_d") * F.lag("_d").over(series) == -1, 1).otherwise(0)).over(series))
    lows = marked.where("low = _least").select(*SERIES, F.col("bar_idx").alias("_i"), F.floor(F.col("bar_idx") / SPAN).alias("_span"))
    spans = windows.select(*SERIES, "start_row", "window_len", F.col("start_row").alias("first"), (F.col("start_row") + F.col("window_len") - 1).alias("last"))
    spans = lowest_in(bars, spans)
    inside = (F.col("_i") >= F.col("first") + k) & (F.col("_i") <= F.col("last") - k)
    key = [*SERIES, "start_row", "window_len"]
    near = spans.withColumn("_span", F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN)))).join(lows, [*SERIES, "_span"]).where(inside)
    near = near.groupBy(*key).agg(F.array_sort(F.collect_list("_i")).alias("_lows"))  # bounded by the window's length
    both = spans.join(near, key, "left").withColumn("_lows", spaced(F.coalesce("_lows", F.array().cast("array<int>")), distance))
    both = select_starts(both.withColumn("starts", F.array_sort(F.array_union("_lows", F.array("lowest")))), most)
    each = both.select(*key, "last", F.explode("starts").alias("start"))
    at_last = marked.select(*SERIES, F.col("bar_idx").alias("last"), F.col("low").alias("low_last"), F.col("high").alias("high_last"), F.col("_x").alias("_x_last"))
    at_start = marked.select(*SERIES, F.col("bar_idx").alias("start"), F.lead("_x").over(series).alias("_x_start"))
    each = each.join(at_last, [*SERIES, "last"]).join(at_start, [*SERIES, "start"])
    return each.withColumn("extrema", F.greatest(F.lit(0), F.coalesce(F.col("_x_last") - F.col("_x_start"), F.lit(0)))).drop("_x_last", "_x_start")


def select_starts(starts: DataFrame, m: int) -> DataFrame:
    """At most m starts: the first m - 1 and the lowest."""
    some = F.when(F.size("starts") > m, F.slice(F.array_sort(F.array_union(F.slice("starts", 1, max(1, m - 1)), F.array("lowest"))), 1, m)).otherwise(F.col("starts"))
    return starts.withColumn("starts", some)


def first_starts(starts: DataFrame, m: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """The same of low_starts' rows: of each series at most m, the first m - 1 and the lowest."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    first = starts.withColumn("_nth", nth).where(F.col("_nth") <= m)
    n = starts.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.when(F.col("lowest"), F.col("start"))).alias("_at"))
    some = first.join(n, list(keys)).where((F.col("_n") <= m) | (F.col("_nth") <= max(1, m - 1)))
    rest = n.where(F.col("_n") > m).select(*keys, F.col("_at").alias("start"), F.lit(True).alias("lowest"))
    both = some.select(*keys, "start", "lowest").unionByName(rest).groupBy(*keys, "start").agg(F.max("lowest").alias("lowest"))
    return both.withColumn("_nth", nth).where(F.col("_nth") <= m).drop("_nth")


def count_extrema(bars: DataFrame, column: str = "low") -> DataFrame:
    """Sign changes between successive differences of each series; a zero difference resets the sign."""
    w = Window.partitionBy(*SERIES).orderBy("bar_idx")
    d = bars.withColumn("_s", F.signum(F.col(column) - F.lag(column).over(w)))
    d = d.withColumn("_p", F.lag("_s").over(w))
    return d.groupBy(*SERIES).agg(F.sum(F.when(F.col("_s") * F.col("_p") == -1, 1).otherwise(0)).alias("extrema"))


def base_score(bars: DataFrame, bearish: bool = False) -> DataFrame:
    """Per bar, over the ten bars from it: 0.4 * population deviation of the lows + 0.3 * range over the bar's low (high)."""
    ahead = Window.partitionBy(*SERIES).orderBy("bar_idx").rowsBetween(0, 9)
    ref = F.col("high" if bearish else "low")
    score = 0.4 * F.stddev_pop("low").over(ahead) + 0.3 * (F.max("high").over(ahead) - F.min("low").over(ahead)) / (ref + 1e-9)
    return bars.select(*SERIES, "bar_idx", score.alias("base_score"))


def absolute_low(bars: DataFrame) -> DataFrame:
    """The first bar of the least low of each series."""
    return bars.groupBy(*SERIES).agg(F.min_by("bar_idx", F.struct("low", "bar_idx")).alias("bar_idx"), F.min("low").alias("low"))
