import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import rules as R
from wavemill.functions import scoring as E
from wavemill.functions.waves import WAVE, polyline, roll_up
from wavemill.operators import backtest as B
from wavemill.operators import chains as C
from wavemill.operators import cleaning as K
from wavemill.operators import quality as Q
from wavemill.operators import scan as P
from wavemill.operators import stats as A
from wavemill.operators import swings as M
from wavemill.operators import windows as W
from wavemill.sources import bars as I
from wavemill.sources import sinks
from wavemill.streaming.bars import clean_stream, resample_stream

#: lengths and durations of stored corrections, with their Fibonacci and ensemble scores
GOLDENS = [
    ((0.6752020120620728, 0.31579798460006714, 0.468533992767334), (232, 53, 202), 0.9, 0.9308568965517241),
    ((0.10041599720716476, 0.053206004202365875, 0.07952700322493911), (91, 260, 288), 0.7, 0.8057010989010988),
    ((10.679868698120117, 5.759119033813477, 9.816325187683105), (371, 87, 193), 0.9, 0.9366142857142857),
    ((34.55999946594238, 15.770002365112305, 27.670001983642578), (236, 87, 95), 0.7, 0.8433050847457626),
]


def correction(lengths, durations, top=100.0):
    a, b, c = lengths
    i, j, k = np.cumsum(durations).tolist()
    low_a, high_b = top - a, top - a + b
    return [("A", 0, i, low_a, top, i, 0, a, durations[0]), ("B", i, j, low_a, high_b, i, j, b, durations[1]), ("C", j, k, high_b - c, high_b, k, j, c, durations[2])]


def five(lengths, durations=(4, 3, 5, 3, 4), start=10.0, up=True):
    rows, at, i = [], start, 0
    for n, (size, d) in enumerate(zip(map(float, lengths), durations, strict=True)):
        rising = (n % 2 == 0) == up
        to = at + size if rising else at - size
        low, high = min(at, to), max(at, to)
        rows.append((str(n + 1), i, i + d, low, high, i if rising else i + d, i + d if rising else i, size, d))
        at, i = to, i + d
    return rows


def frame(spark, waves):
    return spark.createDataFrame([(w,) for w in waves], f"waves array<{WAVE}>")


def make_bars(spark, series):
    rows = [(name, "1wk", i, lo, hi) for name, prices in series.items() for i, (lo, hi) in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, interval string, bar_idx int, low double, high double")


def random_series(rng, n, top=6):
    return [(float(min(a, b)), float(max(a, b))) for a, b in ((rng.randint(0, top), rng.randint(0, top)) for _ in range(n))]


def walk(low, high, s, up, skips, strict=False):
    """A monowave bar by bar: (end, value) or None."""
    if not up:
        low, high = [-x for x in high], [-x for x in low]
    value, e = low[s], s
    for i in range(s + 1, len(high)):
        if not high[i] > value:
            break
        value, e = high[i], i
    for _ in range(skips):
        top, at, reached, found = low[e], None, False, None
        for i in range(e + 1, len(high)):
            if high[i] < value and not reached:
                continue
            if high[i] > value and not reached:
                reached, top, at = True, high[i], i
            elif high[i] > top:
                top, at = high[i], i
            else:
                found = (top, at)
                break
        if found is None:
            return None
        if found[0] > value:
            value, e = found
            if (strict or not up) and min(low[s:e]) < low[s]:
                return None
    return e, value if up else -value


def test_scores_of_stored_patterns(spark):
    df = frame(spark, [correction(x, d) for x, d, _, _ in GOLDENS]).withColumn("e", E.ensemble_score(F.col("waves"), F.lit(1.0)))
    got = df.select("e.score", "e.fib", R.check_rule(R.correction(F.col("waves"))).alias("ok")).collect()
    for row, (_, _, fib, ensemble) in zip(got, GOLDENS, strict=True):
        assert row.fib == fib and row.score == pytest.approx(ensemble, abs=1e-12) and row.ok
    checked = Q.validate_patterns(frame(spark, [correction(x, d) for x, d, _, _ in GOLDENS]).withColumn("rule_name", F.lit("Corrective")))
    assert {r.verdict for r in checked.collect()} == {"valid"}


def test_rules(spark):
    good, bad = five((10, 5, 16, 3, 8)), five((10, 12, 16, 3, 8))
    diagonal, down = five((10, 6, 9.5, 7, 8)), five((10, 5, 16, 3, 8), up=False, start=100.0)
    rows = frame(spark, [good, bad, diagonal, down])
    w = F.col("waves")
    got = rows.select(*[R.check_rule(R.RULE_SETS[n](w)).alias(n) for n in ("impulse", "leading_diagonal", "bearish_impulse")], R.first_violation(R.impulse(w)).alias("v"), R.score_rule(R.impulse(w)).alias("s")).collect()
    assert [r.impulse for r in got] == [True, False, False, False] and [r.bearish_impulse for r in got] == [False, False, False, True]
    assert got[0].v is None and got[0].s == 1.0 and got[1].v is not None and got[1].s < 1
    assert not got[0].leading_diagonal
    rolled = rows.select(roll_up(w).alias("r"), F.size(polyline(w)).alias("n")).collect()
    assert rolled[0].r.degree == 2 and rolled[0].r.low == 10.0 and rolled[0].r.high == 36.0 and rolled[0].n == 6


def test_kernel_is_the_walk():
    rng = random.Random(11)
    for _ in range(1500):
        prices = random_series(rng, rng.randint(1, 12))
        low, high = map(np.array, zip(*prices, strict=True))
        for up in (True, False):
            for strict in (False, True):
                edges = {(s, k): (e, v, need) for s, k, e, v, need in M.kernel(low, high, up, 4, strict)}
                for s in range(len(low)):
                    for k in range(5):
                        want = walk(low.tolist(), high.tolist(), s, up, k, strict)
                        got = edges.get((s, k))
                        assert (got[:2] if got else None) == want, (prices, s, up, k)
                        if got and k:  # the edge needs the bars up to need and no more
                            need = got[2]
                            assert walk(low[: need + 1].tolist(), high[: need + 1].tolist(), s, up, k, strict) == want


def test_expressions_are_the_kernel(spark):
    rng = random.Random(5)
    series = {f"s{i}": random_series(rng, 25) for i in range(8)}
    bars = make_bars(spark, series)
    edges = {(r.symbol, r.s, r.up, r.skip): r for r in M.monowaves(bars, 1).collect()}
    for up in (True, False):
        for r in M.first_swing(bars, "up" if up else "down").collect():
            e = edges[r.symbol, r.s, up, 0]
            assert (e.e, e.high if up else e.low) == (r.e, r.value)
    nexts = {(r.symbol, r.s): (r.e, r.value) for r in M.next_swing(bars).collect()}
    assert nexts == {(k[0], k[1]): (e.e, e.high) for k, e in edges.items() if k[2] and k[3] == 1}


def test_down_swings_and_turns_are_the_walk(spark):
    rng = random.Random(6)
    series = {f"s{i}": random_series(rng, 20) for i in range(6)}
    bars = make_bars(spark, series)
    edges = M.monowaves(bars, 1).collect()
    nexts = {(r.symbol, r.s): r for r in M.next_swing(bars, "down").collect()}
    for name, prices in series.items():
        low, high = map(list, zip(*prices, strict=True))
        for s in range(len(low)):
            got = nexts.get((name, s))
            mirrored = walk([-x for x in high], [-x for x in low], s, True, 1)
            assert ((got.e, -got.value) if got else None) == mirrored, (name, s)
    for e in edges:
        prices = series[e.symbol]
        beyond = [i for i in range(e.e, len(prices)) if (prices[i][1] > e.high if e.up else prices[i][0] < e.low)]
        assert e.turn == (beyond[0] if beyond else len(prices))


def test_starts(spark):
    rng = random.Random(8)
    series = {"a": random_series(rng, 80, 30), "b": random_series(rng, 3), "c": [(5.0, 5.0)] * 40}
    got = {r.symbol: r for r in W.select_starts(W.local_lows(make_bars(spark, series), 5, 10), 4).collect()}
    for name, prices in series.items():
        low, taken = [p[0] for p in prices], []
        for i in range(5, len(low) - 5):
            if low[i] == min(low[i - 5 : i + 6]) and (not taken or i - taken[-1] >= 10):
                taken.append(i)
        lowest = low.index(min(low))
        taken = sorted({*taken, lowest})
        want = taken if len(taken) <= 4 else sorted({*taken[:3], lowest})[:4]
        assert list(got[name].starts) == want


def test_skip_ahead_agrees_with_the_grid(spark):
    rng = random.Random(2)
    series = {}
    for name in ("x", "y"):
        p, prices = 50.0, []
        for _ in range(160):
            p = max(5.0, p + rng.choice([-3, -2, -1, 1, 2, 3]))
            prices.append((p - rng.random(), p + rng.random()))
        series[name] = prices
    bars = make_bars(spark, series)
    found = P.candidates(spark, bars, 3).persist()
    walked = P.skip_ahead_scan(bars, found, {"1wk": (20, 60, 5)}).collect()
    assert walked and all(r.error is None for r in walked)
    windows = spark.createDataFrame([(r.symbol, r.interval, r.start_row, r.window_len) for r in walked], "symbol string, interval string, start_row int, window_len int")
    grid = {(r.symbol, r.start_row): (r.start, r.rule_name, list(r.wave_config)) for r in P.scan_grid(bars, windows, found).collect()}
    assert grid == {(r.symbol, r.start_row): (r.start, r.rule_name, list(r.wave_config)) for r in walked}
    for name in series:
        rows = sorted((r.start_row, r.end) for r in walked if r.symbol == name)
        assert all(b[0] >= a[1] + 5 for a, b in zip(rows, rows[1:], strict=False))
    back = C.reconstruct(found.select("symbol", "interval", "start", "rule_name", "wave_config"), M.monowaves(bars, 2)).collect()
    assert back and all(r.passes for r in back)
    best = C.best_per_window(P.scan_grid(bars, windows, found)).collect()
    assert all(set(r.best.waves) in ({"wave1", "wave2", "wave3", "wave4", "wave5"}, {"waveA", "waveB", "waveC"}) for r in best)
    found.unpersist()


def window_chains(low, high, family, skips):
    """A family's waves from the walk over a window's own bars, or None."""
    plan, at, out = C.FAMILIES[family], skips[0], []
    for (label, up), skip in zip(plan, skips[1:], strict=True):
        got = walk(low, high, at, up, skip)
        if got is None:
            return None
        e, value = got
        lo, hi = (low[at], value) if up else (value, high[at])
        out.append((label, at, e, float(lo), float(hi), at if up else e, e if up else at, abs(hi - lo), e - at))
        at = e
    if len(plan) == 5:
        sign, level = (1, 3) if family == "impulse" else (-1, 4)
        prices = low if family == "impulse" else [-x for x in high]
        for a, b, empty in ((out[1], out[3], False), (out[3], out[4], True)):
            part = prices[a[2] : b[2]]
            if not (sign * a[level] <= min(part) if part else empty):
                return None
    return out


def test_grid_is_each_window_by_itself(spark):
    """Starts, extrema, chains cut by the window's end, equal prices and cuts, all from the window's own bars."""
    rng = random.Random(21)
    series = {}
    shapes = [(10, -5, 16, -3, 8), (-10, 5, -16, 3, -8), (-10, 5, -8), (6, -3, 9, -4, 7), (-6, 3, -5)]
    for name in ("x", "y"):
        p, prices = 200.0, []
        while len(prices) < 90:
            for leg in rng.choice(shapes):
                bars_of = rng.randint(2, 4)
                for _ in range(bars_of):
                    p += leg / bars_of
                    prices.append((p - rng.choice([0.25, 0.25, 0.5]), p + rng.choice([0.25, 0.25, 0.5])))
        series[name] = prices[:90]
    bars, up_to, n = make_bars(spark, series), 2, 3
    spans = [(name, "1wk", i, size) for name in series for i in range(0, 60, 3) for size in (20, 29)]
    windows = spark.createDataFrame(spans, "symbol string, interval string, start_row int, window_len int")
    options = {f: [list(r.skips) for r in C.top_options(C.skip_options(spark, up_to, len(C.FAMILIES[f])), 32).orderBy("rank").collect()] for f in P.FAMILIES}
    rows, extrema = [], {}
    for name, _, i, size in spans:
        low, high = ([x[c] for x in series[name][i : i + size]] for c in (0, 1))
        taken = []
        for j in range(5, size - 5):
            if low[j] == min(low[j - 5 : j + 6]) and (not taken or j - taken[-1] >= 10):
                taken.append(j)
        for start in sorted({*taken, low.index(min(low))}):
            d = np.sign(np.diff(low[start:]))
            extrema[name, i, size, start] = int((d[1:] * d[:-1] == -1).sum())
            for f, some in options.items():
                rows += [(name, "1wk", i, size, start, f, rank, config, w) for rank, config in enumerate(some, 1) if (w := window_chains(low, high, f, [start, *config]))]
    made = spark.createDataFrame(rows, f"symbol string, interval string, start_row int, window_len int, start int, family string, rank int, wave_config array<int>, waves array<{WAVE}>")
    every = []
    for f in P.FAMILIES:
        every += C.scored(made.where(F.col("family") == f), f).collect()
    want, cut_ends = {}, 0
    groups = {}
    for r in every:
        key = (r.symbol, r.start_row, r.window_len)
        if r.family != "impulse" or extrema[(*key, r.start)] >= 4:
            groups.setdefault(key, {}).setdefault(r.start, {}).setdefault(r.family, []).append(r)
    best = lambda r: (-r.ensemble_score, -r.waves[-1].idx_end)
    for key, starts in groups.items():
        seen, unique = set(), []
        for start in sorted(starts):
            mine = []
            for f in P.FAMILIES:
                once = {}
                for r in sorted(starts[start].get(f, ()), key=lambda r: r.rank):
                    once.setdefault(tuple((w.low, w.high) for w in r.waves), r)
                mine += sorted(once.values(), key=best)[: 2 * n]
            for r in sorted(mine, key=best)[:n]:
                if (twin := (r.family, *((w.low, w.high) for w in r.waves))) not in seen:
                    seen.add(twin)
                    unique.append(r)
        want[key] = [(r.start + key[1], r.rule_name, tuple(r.wave_config), r.waves[-1].idx_end + key[1], round(r.ensemble_score, 9)) for r in sorted(unique, key=best)[:n]]
        cut_ends += sum(w[3] == key[1] + key[2] - 1 and w[2][-1] == 0 for w in want[key])
    found, cut = P.candidates(spark, bars, up_to, 32), P.open_chains(spark, bars, up_to, 32)
    got = {}
    for r in P.scan_grid(bars, windows, found, n=n, cut=cut).orderBy("nth").collect():
        got.setdefault((r.symbol, r.start_row, r.window_len), []).append((r.start, r.rule_name, tuple(r.wave_config), r.waves[-1].idx_end, round(r.ensemble_score, 9)))
    assert got == want and cut_ends > 3 and len(want) > 10
    walked = P.skip_ahead_scan(bars, found, {"1wk": (20, 29, 3)}, cut=cut).collect()
    assert walked and all(r.error is None for r in walked)
    for r in walked:
        if r.window_len == 29 and (r.symbol, r.start_row, 29) in want:
            assert (r.start, r.rule_name, tuple(r.wave_config), r.end) == want[r.symbol, r.start_row, 29][0][:4]


def test_skip_ahead_reads_the_whole_series_and_keeps_hits_before_an_error(spark, tmp_path):
    bars = make_bars(spark, {name: [(1000.0 - i if i <= 580 else 420.0 + i - 580, 2000.0) for i in range(620)] for name in ("long", "bad")})
    rows = [("long", 580, 590), ("bad", 10, 20), ("bad", 580, None)]
    wave = "symbol string, interval string, start int, rule_name string, wave_config array<int>, need_idx int, ensemble_score double, waves array<struct<idx_end: int>>"
    interval = bars.first()["interval"]
    found = spark.createDataFrame([(n, interval, a, "r", [0], a + 10, 1.0, [(b,)]) for n, a, b in rows], wave)
    bars = bars.withColumn("low", F.when((F.col("symbol") == "bad") & (F.col("bar_idx") == 10), 1.0).otherwise(F.col("low")))
    got = P.skip_ahead_scan(bars, found, {interval: (20, 20, 1)})
    rows = sorted((r.symbol, r.start or 0, r.end or 0, r.error is not None) for r in got.collect())
    assert rows == [("bad", 0, 0, True), ("bad", 10, 20, False), ("long", 580, 590, False)]
    P.commit_run(got, f"{tmp_path}/run", "r1")
    assert [r.symbol for r in spark.read.parquet(f"{tmp_path}/run/hits").collect()] == ["long"]


def test_failures_and_resume(spark, tmp_path):
    bars = make_bars(spark, {"ok": [(1.0, 2.0)] * 30, "bad": [(1.0, 2.0)] * 30})
    broken = P.skip_ahead_scan(bars, P.candidates(spark, bars, 2), {}).collect()
    assert len(broken) == 2 and all("KeyError" in r.error for r in broken)
    P.commit_run(spark.createDataFrame(broken, P.skip_ahead_scan(bars, P.candidates(spark, bars, 2), {}).schema), f"{tmp_path}/run", "r1")
    assert spark.read.parquet(f"{tmp_path}/run/failures").count() == 2
    series = bars.select("symbol", "interval").distinct()
    assert [r.symbol for r in P.pending(series, series.where("symbol = 'ok'")).collect()] == ["bad"]


def dirty(spark):
    rows = [("A", "1d", f"2024-01-{d:02d} 00:00:00", 10.0, 12.0, 9.0, 11.0, 5.0, d) for d in range(1, 11)]
    rows += [("A", "1d", "2024-01-03 00:00:00", 10.0, 12.0, 9.0, 11.0, 5.0, 50), ("A", "1d", "2031-01-01 00:00:00", 10.0, 12.0, 9.0, 11.0, 5.0, 51), ("A", "1d", "2024-01-11 00:00:00", 0.0, 12.0, 0.0, 11.0, 5.0, 52)]
    rows += [("A", "1d", "2024-01-12 00:00:00", 10.0, 12.0, 9.0, 11.0, -1.0, 53), ("A", "1d", "2024-01-13 00:00:00", 10.0, 8.0, 9.0, 9.0, 5.0, 54), ("A", "1d", "2024-01-14 00:00:00", 300.0, 300.0, 9.0, 300.0, 5.0, 55), ("A", "1d", None, 10.0, 12.0, 9.0, 11.0, 5.0, 56)]
    df = spark.createDataFrame(rows, "symbol string, interval string, bar_ts string, open double, high double, low double, close double, volume double, ord int")
    return df.withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))


def test_cleaning_reasons(spark):
    clean, report = K.validate_bars(dirty(spark), "2025-01-01 00:00:00", ["ord"], least=5)
    assert {r.reason: r.n for r in report.collect()} == {"kept": 10, "duplicate": 1, "datetime": 1, "price": 1, "volume": 1, "high_below_low": 1, "outlier": 1, "missing": 1}
    assert clean.count() == 10 and max(r.ord for r in clean.collect()) == 10
    step = K.min_bars(K.drop_outliers(K.valid_ohlc(K.valid_volume(K.valid_prices(K.dedup_bars(K.valid_datetime(K.drop_missing(dirty(spark)), "2025-01-01 00:00:00"), ["ord"]))))), 5)
    assert step.count() == 10


def test_sources_and_sinks(spark, tmp_path):
    df = dirty(spark).drop("ord").where("bar_ts < '2024-02-01'").dropDuplicates(["bar_ts"])
    df.select(F.col("bar_ts").alias("DateTime"), F.col("symbol").alias("Ticker"), "Open", "High", "Low", "Close", "Volume").write.parquet(f"{tmp_path}/stocks/market_data_1d.parquet")
    bars = I.read_bars(spark, f"{tmp_path}/stocks", "1d")
    assert {r.interval for r in bars.collect()} == {"1d"} and bars.count() == df.count()
    # the folder of a data set that Spark wrote is its parent
    assert {r.interval for r in I.combine_bars(spark, [f"{tmp_path}/stocks"]).collect()} <= {"1d", None}
    with pytest.raises(ValueError):
        I.normalize_bars(spark.range(1))
    sinks.write_bars(bars, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == bars.count()
    (tmp_path / "names.txt").write_text(" AA \n\nBB\n")
    assert [r.symbol for r in I.read_symbols(spark, f"{tmp_path}/names.txt").collect()] == ["AA", "BB"]
    (tmp_path / "m.json").write_text(json.dumps({"markets": {"US": {"AA": {"rows": 5, "min_date": "a", "max_date": "b"}}}, "failures": {"US": {"BB": "gone"}}}))
    markets, failures = I.read_manifest(spark, f"{tmp_path}/m.json")
    assert markets.collect()[0].rows == 5 and failures.collect()[0].reason == "gone"
    (tmp_path / "p.json").write_text(json.dumps({"metadata": {}, "patterns": [{"symbol": "AA", "ensemble_score": 0.9}, {"symbol": "BB", "ensemble_score": 0.4}]}))
    patterns = I.read_patterns(spark, f"{tmp_path}/p.json")
    assert patterns.count() == 2 and I.filter_patterns(patterns, min_score=0.5).count() == 1
    sinks.export_filtered(patterns, 0.5, f"{tmp_path}/kept")
    assert spark.read.json(f"{tmp_path}/kept/metadata").collect()[0].filtered_count == 1
    sinks.write_patterns(patterns.withColumn("interval", F.lit("1d")), f"{tmp_path}/all")
    assert spark.read.json(f"{tmp_path}/all/metadata").collect()[0].patterns == 2


def test_backtest(spark, tmp_path):
    days = [f"2024-01-{d:02d} 00:00:00" for d in (1, 2, 5, 8, 9)]
    prices = [(100, 101, 99), (100, 112, 94), (100, 104, 96), (98, 99, 94), (97, 98, 96)]
    bars = spark.createDataFrame([("S", i, t, float(h), float(lo), float(c)) for i, (t, (c, h, lo)) in enumerate(zip(days, prices, strict=True))], "symbol string, bar_idx int, bar_ts string, high double, low double, close double").withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
    rows = [("S", 0, "impulse", days[0], days[0]), ("S", 1, "impulse", days[0], "2024-01-03 00:00:00"), ("S", 2, "Corrective", days[0], days[0]), ("S", 3, "impulse", days[0], days[4])]
    p = spark.createDataFrame([(*r, 0.9) for r in rows], "symbol string, start int, rule_name string, date_start string, date_end string, ensemble_score double")
    p = p.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("date_start", "date_end")})
    t = B.simulate_trades(p, bars)
    got = {r.start: r for r in t.collect()}
    # profit is taken before the stop of the same bar; an entry between bars goes to the next bar; no bar ahead, no trade
    assert set(got) == {0, 1} and got[0].exit_price == pytest.approx(110.0) and got[1].exit_price == pytest.approx(95.0)
    m = B.backtest_metrics(t).collect()[0]
    assert (m.trades, m.wins, m.losses) == (2, 1, 1) and m.profit_factor == pytest.approx(2.0)
    assert B.max_drawdown(t).collect()[0].max_drawdown == pytest.approx(50 / 1100)
    assert B.sharpe(t.limit(1)).collect()[0].sharpe == 0.0
    old = {r.start: r for r in B.simulate_trades(p, bars, entry_index="first").collect()}
    assert old[1].exit_price == pytest.approx(110.0)
    sinks.write_trades(t, f"{tmp_path}/log")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/log").count() == 2


def test_exclusive_quartiles(spark):
    import statistics

    for n in (1, 3, 4, 7, 10):
        x = [random.Random(n).random() for _ in range(n)]
        row = A.score_distribution(spark.createDataFrame([("g", v) for v in x], "g string, v double"), "v", ["g"]).collect()[0]
        want = statistics.quantiles(x, n=4) if n >= 4 else [min(x), 0, max(x)]
        assert row.q25 == pytest.approx(want[0]) and row.q75 == pytest.approx(want[2])


def test_stream(spark, tmp_path):
    df = dirty(spark).where("bar_ts is not null").drop("ord")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = resample_stream(clean_stream(stream), "2 days", "2d").writeStream.format("memory").queryName("binned").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(volume) v from binned").collect()[0].v == clean_stream(df).agg(F.sum("volume").alias("v")).collect()[0].v


def test_empty(spark):
    bars = make_bars(spark, {"a": [(1.0, 2.0)]}).limit(0)
    assert M.monowaves(bars, 2).count() == 0 and M.first_swing(bars).count() == 0 and W.local_lows(bars).count() == 0
    assert P.candidates(spark, bars, 2).count() == 0
