"""Series in blocks, pieces and by pointer doubling, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_waves import make_bars, walk

from wavemill.operators import ranges, scan, skyline, swings, walks, windows


def series_of(seed, n, kind):
    rng = random.Random(seed)
    if kind == "ties":
        return [(low := rng.choice([1.0, 2.0, 3.0]), low + rng.choice([0.0, 0.0, 1.0, 2.0])) for _ in range(n)]
    if kind == "vee":
        return [(abs(i - n / 2), abs(i - n / 2) + 1.0) for i in range(n)]
    if kind == "rising":
        return [(float(i), i + 0.5) for i in range(n)]
    p, out = 50.0, []
    for _ in range(n):
        p = max(5.0, p + rng.choice([-3, -2, -1, 1, 2, 3]))
        out.append((p - rng.random(), p + rng.random()))
    return out


ALL = {f"{kind}{n}": series_of(n, n, kind) for kind, n in (("ties", 90), ("vee", 70), ("rising", 50), ("walk", 130), ("walk", 33), ("ties", 7), ("ties", 1))}


def test_later_bars_are_a_scan(spark):
    got = {(r.symbol, r.up, r.i): r for r in skyline.later_bars(make_bars(spark, ALL), 8).collect()}
    for name, prices in ALL.items():
        for up in (True, False):
            px = [(lo, hi) if up else (-hi, -lo) for lo, hi in prices]
            for i, (lo, hi) in enumerate(px):
                first = lambda test: next((j for j in range(i + 1, len(px)) if test(px[j][1])), None)  # noqa: E731, B023
                end = i
                while end + 1 < len(px) and px[end + 1][1] > px[end][1]:
                    end += 1
                r = got[name, up, i]
                assert (r.greater, r.not_less, r.reach, r.run_end, r.last) == (first(lambda x: x > hi), first(lambda x: x >= hi), first(lambda x: x >= lo), end, len(px) - 1)  # noqa: B023


@pytest.mark.parametrize("strict", [False, True])
def test_edges_of_blocks_are_the_arrays(spark, strict):
    bars = make_bars(spark, ALL)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(swings.monowaves(bars, 4, strict))
    assert rows(swings.monowaves(bars, 4, strict, block=8)) == whole
    assert rows(swings.monowaves(bars, 4, strict, block=50)) == whole
    got = {(r[0], r[3], r[2], r[4]): r[5] for r in whole}
    for name in ("ties90", "walk33"):
        low, high = (np.array([p[i] for p in ALL[name]]) for i in (0, 1))
        for s in range(len(low)):
            for skip in range(5):
                want = walk(low, high, s, True, skip) if not strict else None
                if want is not None:
                    assert got[name, True, s, skip] == want[0]


def test_one_long_series_is_spread(spark):
    n = 100_000
    rng = np.random.default_rng(4)
    p = 1000 + np.cumsum(rng.normal(size=n))
    bars = spark.createDataFrame([("one", "1m", i, float(x - 0.5), float(x + 0.5)) for i, x in enumerate(p)], "symbol string, interval string, bar_idx int, low double, high double")
    got = swings.monowaves(bars, 1, block=8192)
    assert got.groupBy(F.spark_partition_id()).count().count() > 1
    want = swings.swings(p - 0.5, p + 0.5, True, 1)
    rows = {(r.s, r.skip): (r.e, r.need_idx, r.turn) for r in got.where("up").collect()}
    assert rows == {(s, k): (e, need, turn) for s, k, e, need, turn in zip(*(want[c].tolist() for c in ("s", "skip", "e", "need_idx", "turn")), strict=True)}


def test_nearest_and_running_over_pieces(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abbbbbbb"), rng.randrange(300), i, rng.choice([None, None, None, i]), float(rng.randrange(-20, 21))) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int, x double").repartition(3)
    got = {r.i: (r._ahead, r._behind) for r in ranges.nearest(df, ["k"], ["t", "i"], "v").collect()}
    for k, t, i, _, _ in rows:
        mine = sorted((b, c, v) for a, b, c, v, _ in rows if a == k and v is not None)
        ahead, behind = [v for b, c, v in mine if (b, c) >= (t, i)], [v for b, c, v in mine if (b, c) <= (t, i)]
        assert got[i] == (ahead[0] if ahead else None, behind[-1] if behind else None)
    sums = {r.i: (r._sum, r._top) for r in ranges.running(df, ["k", "t", "i"], F.col("x")).collect()}
    total = top = 0.0
    for _, _, i, _, x in sorted(rows, key=lambda r: r[:3]):
        total += x
        top = max(top, total)
        assert sums[i] == (total, top)
    assert ranges.running(df.limit(0), ["k", "t", "i"], F.col("x")).count() == 0


def test_walks_by_doubling(spark):
    rng = random.Random(3)
    steps = [(k, i, i + rng.randrange(1, 4) if rng.random() < 0.97 else None, rng.randrange(1, 5)) for k in ("a", "b", "c") for i in range(200)]
    df = spark.createDataFrame(steps, "k string, at int, then int, cost int")
    starts = spark.createDataFrame([("a", 0, 1), ("b", 5, 2), ("c", 999, 1)], "k string, at int, seen int")
    got = {(r.k, r.at): r.seen for r in walks.visited(df, starts, ["k"]).collect()}
    want, table = {}, {(k, i): (j, c) for k, i, j, c in steps}
    for k, at, seen in (("a", 0, 1), ("b", 5, 2), ("c", 999, 1)):
        want[k, at] = seen
        while (k, at) in table and (nxt := table[k, at])[0] is not None:
            at, seen = nxt[0], seen + nxt[1]
            want[k, at] = seen
    assert got == want


def test_spaced_lows_are_a_loop(spark):
    got = {}
    for r in windows.low_starts(make_bars(spark, ALL), 5, 10).collect():
        got.setdefault(r.symbol, []).append((r.start, r.lowest))
    for name, prices in ALL.items():
        low = [p[0] for p in prices]
        taken = []
        for i in range(5, len(low) - 5):
            if low[i] == min(low[i - 5 : i + 6]) and (not taken or i - taken[-1] >= 10):
                taken.append(i)
        least = low.index(min(low))
        assert sorted(got[name]) == sorted((i, i == least) for i in {*taken, least})


def test_walk_stops_after_max_windows(spark):
    bars = make_bars(spark, {"x": [(1000.0 - i if i <= 40 else 920.0 + i, 2000.0) for i in range(120)]})
    interval = bars.first()["interval"]
    found = spark.createDataFrame([("x", interval, 40, "r", [0], 50, 1.0, [(50,)])], "symbol string, interval string, start int, rule_name string, wave_config array<int>, need_idx int, ensemble_score double, waves array<struct<idx_end: int>>")
    first = scan.skip_ahead_scan(bars, found, {interval: (20, 30, 4)}).collect()[0].start_row
    for most in (first // 4, first // 4 + 1):
        assert scan.skip_ahead_scan(bars, found, {interval: (20, 30, 4)}, max_windows=most).count() == (most > first // 4)


def test_growing_windows_end_in_a_hit(spark):
    """What is scanned at the first length at which a candidate can show is what a scan of all lengths finds first."""
    bars = make_bars(spark, {f"walk{i}": series_of(i, 150, "walk") for i in range(5)}).cache()
    geometry = spark.createDataFrame([("1wk", 20, 90, 3)], "interval string, min_len int, max_len int, slide int")
    found, cut = scan.candidates(spark, bars, 2).cache(), scan.open_chains(spark, bars, 2).cache()
    rules = ("impulse", "leading_diagonal", "bearish_impulse", "Corrective")
    every = windows.first_hit(scan.scan_grid(bars, windows.adaptive_windows(bars, geometry, 4), found, cut=cut))
    row = lambda r: (r.symbol, r.start_row, r.window_len, r.start, r.rule_name, tuple(r.wave_config), round(r.ensemble_score, 9))
    got = scan.first_hits(bars, geometry, 4, found, cut=cut, families=scan.FAMILIES, rules=rules).collect()
    assert sorted(map(row, got)) == sorted(map(row, every.collect())) and len(got) > 20


def test_beginnings_that_cannot_hold_go_early(spark):
    """Pruned chains lose none that satisfy a rule set, nor any that a window's end may cut to one that does."""
    from wavemill.operators import chains

    bars = make_bars(spark, {f"walk{i}": series_of(i, 130, "walk") for i in range(3)})
    edges = swings.monowaves(bars, 1).cache()
    for family in ("impulse", "bearish_impulse", "corrective"):
        options = chains.top_options(chains.skip_options(spark, 2, len(chains.FAMILIES[family])), 32)
        whole = chains.chains(edges, family, options=options, complete=True)
        pruned = chains.chains(edges, family, options=options, complete=True, prune=True)
        row = lambda r: (r.symbol, r.start, tuple(r.wave_config))
        held = sorted(map(row, chains.scored(chains.guard(whole, family), family).collect()))
        assert held == sorted(map(row, chains.scored(chains.guard(pruned, family), family).collect()))
        assert pruned.count() < whole.count()
        short = chains.chains(edges, family, options=options, complete=True, prune=True, longest=25)
        assert sorted(map(row, short.where("need_idx - start < 25").collect())) == sorted(map(row, pruned.where("need_idx - start < 25").collect()))


def test_empty_tables(spark):
    from wavemill.operators import backtest, degrees, resample

    bars = make_bars(spark, {"a": [(1.0, 2.0)]}).limit(0)
    found, cut = scan.candidates(spark, bars, 2), scan.open_chains(spark, bars, 2)
    geometry = spark.createDataFrame([("1wk", 20, 90, 3)], "interval string, min_len int, max_len int, slide int")
    assert scan.skip_ahead_scan(bars, found, {"1wk": (20, 60, 5)}, cut=cut).count() == 0
    assert scan.first_hits(bars, geometry, 4, found, cut=cut).count() == 0
    assert degrees.patterns_of_degrees(swings.monowaves(bars, 1)).count() == 0
    assert swings.monowaves(bars, 1, block=0).count() == 0 and skyline.later_bars(bars).count() == 0
    dated = bars.withColumns({"bar_ts": F.lit("2024-01-01").cast("timestamp_ntz"), "close": F.lit(1.0), "open": F.lit(1.0), "volume": F.lit(1.0)})
    assert resample.pyramid(dated).count() == 0
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00")], "symbol string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert backtest.asof_price(events, dated).count() == 0 and backtest.asof_price(events.limit(0), dated).count() == 0
