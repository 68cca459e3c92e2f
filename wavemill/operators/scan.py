"""Scans: candidates once per series, then windows choose among them.

A candidate is a chain of absolute bars with the last bar that must be known for it (need_idx), so it
belongs to every window that holds its start and that bar. A window sees its own bars only, so a chain whose last
wave is a first swing that runs beyond the window's end is cut there: those chains are kept apart, unscored
(open_chains), and finished per window. The scans are joins and spread one long series over many tasks, the skip-ahead
scan, whose next window depends on the last hit, among them (see walks).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chains as C
from .ledger import commit_run  # noqa: F401 (part of the scans' interface)
from .swings import monowaves
from .tables import kept, merged
from .walks import next_stops, visited
from .windows import SPAN, first_hit, window_starts

SERIES = ("symbol", "interval")
WINDOW = (*SERIES, "start_row", "window_len")
FAMILIES = ("impulse", "bearish_impulse", "corrective")
#: Impulses are looked for from starts with at least so many extrema up to the window's end.
LEAST_EXTREMA = 4


def all_chains(spark: SparkSession, bars: DataFrame, up_to: int, top_k: int, families: tuple[str, ...] = FAMILIES, edges: DataFrame | None = None, longest: int | None = None, buckets: int | None = None) -> dict[str, DataFrame]:
    """The chains of each family over the top_k options, as tables; what no last wave can save, and what no window of
    longest bars can hold, is left out wave by wave. With buckets, all is dealt by series to so many (see tables)."""
    edges = kept(monowaves(bars, up_to - 1), buckets, dealt=bool(buckets)) if edges is None else edges
    found = {}
    for family in families:
        n = len(C.FAMILIES[family])
        options = kept(C.top_options(C.skip_options(spark, up_to, n), top_k))
        found[family] = kept(C.early_guard(C.chains(edges, family, options=options, complete=top_k >= up_to**n, prune=True, longest=longest), family), buckets)
    return found


def candidates(
    spark: SparkSession, bars: DataFrame, up_to: int = 3, top_k: int = 300, families: tuple[str, ...] = FAMILIES, distinct: bool = True,
    chains: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """All patterns of the families from every bar, over the top_k options of each: start, rule_name, wave_config,
    waves, need_idx, fib_score, ensemble_score, rank. Distinct: of a start's patterns with the same waves, the first."""
    found = [C.scored(C.guard(c, family), family).drop("turns", "prefix_need") for family, c in (chains or all_chains(spark, bars, up_to, top_k, families)).items()]
    every = reduce(DataFrame.unionByName, found)
    return every.transform(lambda df: C.dedup_candidates(df, (*SERIES, "start", "need_idx"))) if distinct else every


def open_chains(spark: SparkSession, bars: DataFrame, up_to: int = 3, top_k: int = 300, families: tuple[str, ...] = FAMILIES, chains: dict[str, DataFrame] | None = None) -> DataFrame:
    """The chains that a window's end can cut: their last wave is a first swing of more than one bar."""
    last = F.element_at("waves", -1)
    cut = (F.element_at("wave_config", -1) == 0) & (last["idx_end"] > F.greatest(last["idx_start"] + 1, "prefix_need"))
    return reduce(DataFrame.unionByName, [c.where(cut).withColumn("family", F.lit(family)) for family, c in (chains or all_chains(spark, bars, up_to, top_k, families)).items()])


def scan_grid(
    bars: DataFrame, windows: DataFrame, found: DataFrame, k: int = 5, distance: int = 10, max_starts: int = 10, n: int = 1,
    cut: DataFrame | None = None, families: tuple[str, ...] = FAMILIES, buckets: int | None = None,
) -> DataFrame:
    """The n best candidates of each window, from its local lows; with cut (open_chains), also those that the window's end
    cuts short. buckets: of the tables given, if they are dealt by series."""
    if buckets:
        windows = kept(windows, buckets)
    starts = kept(window_starts(bars, windows, k, distance, max_starts), buckets)
    hits = [starts.join(found, [*SERIES, "start"]).where(F.col("need_idx") <= F.col("last"))]
    if cut is not None:
        end = F.element_at("waves", -1)
        met = kept(starts.join(cut, [*SERIES, "start"]).where((F.col("prefix_need") <= F.col("last")) & (end["idx_start"] < F.col("last")) & (end["idx_end"] > F.col("last"))), buckets)
        for family in families:
            short = C.cut_short(met.where(F.col("family") == family), family, F.col("last"), F.col("low_last"), F.col("high_last"))
            hits.append(C.scored(C.guard(short, family), family).select(*hits[0].columns))
    every = reduce(DataFrame.unionByName, hits)
    every = every.where(~F.col("rule_name").isin("impulse", "leading_diagonal") | (F.col("extrema") >= LEAST_EXTREMA))
    return C.best_of_window(every.drop("last", "low_last", "high_last", "extrema"), n, WINDOW, len(families))


def reachable_windows(bars: DataFrame, sizes: DataFrame, found: DataFrame, cut: DataFrame | None) -> DataFrame:
    """The windows that a skip-ahead walk may come to: those on the slide's grid from bar 0, and on the grids that begin
    a slide after a candidate's end. Where chains can be cut, a window's own end may begin a grid, too."""
    n = bars.groupBy(*SERIES).agg(F.count("*").cast("int").alias("n")).join(F.broadcast(sizes), "interval").where("n >= shortest")
    after = found.select(*SERIES, F.element_at("waves", -1)["idx_end"].alias("end")).where("end is not null").distinct()
    grids = n.withColumn("first", F.lit(0)).unionByName(after.join(n, list(SERIES)).withColumn("first", F.col("end") + F.col("slide")).drop("end"))
    if cut is not None:
        ends = cut.select(*SERIES).distinct().withColumn("times", F.lit(True))
        grids = grids.join(ends, list(SERIES), "left").withColumn("times", F.explode(F.sequence(F.lit(0), F.when(F.col("times"), F.col("slide") - 1).otherwise(0))))
        grids = grids.withColumn("first", F.col("first") + F.col("times") * (F.col("longest") - 1 + F.col("slide")))
    # of grids that meet, the one that begins first
    grids = grids.groupBy(*SERIES, "n", "shortest", "longest", "slide", (F.col("first") % F.col("slide")).alias("_rest")).agg(F.min("first").alias("first"))
    grids = grids.where(F.col("first") <= F.col("n") - F.col("shortest"))
    windows = grids.withColumn("start_row", F.explode(F.sequence(F.col("first"), F.col("n") - F.col("shortest"), F.col("slide"))))
    return windows.select(*SERIES, "start_row", F.least("longest", F.col("n") - F.col("start_row")).cast("int").alias("window_len"))


def first_hits(
    bars: DataFrame, geometry: DataFrame, grow: int, found: DataFrame, k: int = 5, distance: int = 10, max_starts: int = 10, cut: DataFrame | None = None,
    families: tuple[str, ...] = ("impulse",), rules: tuple[str, ...] = ("impulse", "leading_diagonal"),
) -> DataFrame:
    """Of windows that grow from each start on the grid, the best candidate of the shortest that has one. No candidate shows
    before its need_idx (one that the window's end cuts, before its last wave begins), so a start's first length is the one
    that reaches the least of these bars among its candidates. It alone is scanned; starts that it fails, as the candidate's first
    bar is no local low there, are scanned at their longer lengths."""
    found = found.where(F.col("rule_name").isin(*rules))
    shows = found.select(*SERIES, F.col("start").alias("first"), F.col("need_idx").alias("shows"))
    if cut is not None:
        cut = cut.where(F.col("family").isin(*families))
        shows = shows.unionByName(cut.select(*SERIES, F.col("start").alias("first"), F.greatest("prefix_need", F.element_at("waves", -1)["idx_start"] + 1).alias("shows")))
    shows = kept(shows.groupBy(*SERIES, "first").agg(F.min("shows").alias("shows")))
    n = bars.groupBy(*SERIES).agg(F.count("*").cast("int").alias("n")).join(F.broadcast(geometry), "interval").where("n >= min_len")
    grid = n.withColumn("start_row", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("min_len"), F.col("slide")))).withColumn("longest", F.least("max_len", F.col("n") - F.col("start_row")))
    span = lambda c: F.floor(c / SPAN)
    near = grid.withColumn("_span", F.explode(F.sequence(span(F.col("start_row")), span(F.col("start_row") + F.col("longest") - 1)))).join(shows.withColumn("_span", span(F.col("first"))), [*SERIES, "_span"])
    near = near.where((F.col("first") >= F.col("start_row")) & (F.col("shows") < F.col("start_row") + F.col("longest")))
    least = near.groupBy(*SERIES, "start_row", "min_len", "longest").agg(F.min("shows").alias("shows"))
    steps = F.ceil(F.greatest(F.lit(0), F.col("shows") - F.col("start_row") + 1 - F.col("min_len")) / grow)
    least = kept(least.withColumn("window_len", (F.col("min_len") + grow * steps).cast("int")).where("window_len <= longest"))
    scan = lambda w: scan_grid(bars, w.select(*WINDOW), found, k, distance, max_starts, 1, cut, families)
    hit = kept(scan(least))
    failed = least.join(hit.select(*SERIES, "start_row"), [*SERIES, "start_row"], "left_anti").where(F.col("window_len") + grow <= F.col("longest"))
    longer = kept(failed.withColumn("window_len", F.explode(F.sequence(F.col("window_len") + grow, F.col("longest"), F.lit(grow)))))
    return hit.unionByName(first_hit(scan(longer)))


def skip_ahead_scan(
    bars: DataFrame, found: DataFrame, geometry: dict[str, tuple[int, int, int]], k: int = 5, distance: int = 10, max_starts: int = 10,
    max_windows: int | None = None, cut: DataFrame | None = None, families: tuple[str, ...] = FAMILIES, buckets: int | None = None,
) -> DataFrame:
    """Per series: the best candidate of the window at i; after a hit, i moves past its end, else by the slide.
    Columns: symbol, interval, start_row, window_len, start, rule_name, wave_config, ensemble_score, end, error.
    Where the walk goes from a hit is known for every window that it may come to, so the hits that it comes by are
    found by pointer doubling, and one long series is spread over many tasks. A series that cannot be walked (an interval
    without geometry or slide, a hit without an end) has a row of its own with the error, after the hits before it.
    The walk ends with the series, or after max_windows windows if given. buckets: of the tables given, if they are dealt by series."""
    spark = bars.sparkSession
    series = list(SERIES)
    sizes = spark.createDataFrame([(i, *map(int, g)) for i, g in geometry.items()], "interval string, shortest int, longest int, slide int")
    walked = sizes.where("slide >= 1")
    best = scan_grid(bars, reachable_windows(bars, walked, found, cut), found, k, distance, max_starts, 1, cut, families, buckets)
    best = kept(best.select(*WINDOW, "start", "rule_name", "wave_config", "ensemble_score", F.element_at("waves", -1)["idx_end"].alias("end")), buckets)

    hits = best.join(F.broadcast(walked.select("interval", "slide")), "interval").withColumn("_rest", F.col("start_row") % F.col("slide"))
    begin = bars.select(*series).distinct().join(F.broadcast(walked.select("interval", "slide")), "interval").withColumns({"pos": F.lit(0), "of": F.lit(None).cast("int")})
    onward = hits.where("end is not null").select(*series, "slide", (F.col("end") + F.col("slide")).alias("pos"), F.col("start_row").alias("of"))
    asks = begin.unionByName(onward).withColumn("_rest", F.col("pos") % F.col("slide"))
    # misses are passed over: the next hit is the first one on the grid that the walk has come to
    nexts = kept(next_stops(hits.select(*series, "_rest", F.col("start_row").alias("at")), asks, [*series, "_rest"]).where("then is not null"))
    windows = ((F.col("then") - F.col("pos")) / F.col("slide") + 1).cast("long")
    steps = nexts.where("of is not null").select(*series, F.col("of").alias("at"), "then", windows.alias("cost"))
    stops = visited(steps, nexts.where("of is null").select(*series, F.col("then").alias("at"), windows.alias("seen")), series)
    if max_windows is not None:
        stops = stops.where(F.col("seen") <= max_windows)
    come_by = merged(stops).select(*series, F.col("at").alias("start_row")).join(best, [*series, "start_row"])
    names = [*WINDOW, "start", "rule_name", "wave_config", "ensemble_score", "end", "error"]
    gone = come_by.where("end is null").select(*series, F.lit("ValueError('a hit has no end')").alias("error"))
    unknown = bars.select(*series).distinct().join(F.broadcast(sizes), "interval", "left").where("slide is null or slide < 1")
    refused = F.when(F.col("slide").isNull(), F.concat(F.lit("KeyError('"), "interval", F.lit("')"))).otherwise(F.lit("ValueError('the slide is one bar at least')"))
    failed = gone.unionByName(unknown.select(*series, refused.alias("error")))
    good = come_by.where("end is not null").withColumn("error", F.lit(None).cast("string"))
    return good.select(*names).unionByName(failed.select(*names[:2], *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in names[2:-1]], "error"))


def pending(series: DataFrame, done: DataFrame) -> DataFrame:
    """Series that no earlier run has done; failed ones are not in done and come again."""
    return series.join(done.select(*SERIES), list(SERIES), "left_anti")
