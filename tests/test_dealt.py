"""Tables dealt by series: what is worked out from them needs no exchange."""

from collections import Counter

from test_blocks import series_of
from test_waves import make_bars

from wavemill.operators import chains, quality, swings, tables


def exchanges(spark, df) -> int:
    """Exchanges by hash in the plan of a table that is kept in buckets."""
    spark.conf.set(tables.CO_PARTITION, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.unset(tables.CO_PARTITION)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chains_of_dealt_edges_move_no_rows(spark):
    bars = make_bars(spark, {f"walk{i}": series_of(i, 60 + 9 * i, "walk") for i in range(7)})
    plain, dealt = tables.kept(swings.monowaves(bars, 0)), tables.kept(swings.monowaves(bars, 0), 5)
    assert spark.conf.get(tables.CO_PARTITION) == "true" and sorted(dealt.collect()) == sorted(plain.collect())
    found = chains.chains(dealt, "impulse")
    assert exchanges(spark, found.repartition(5, "symbol")) == 0 and exchanges(spark, chains.chains(plain, "impulse")) > 0
    per = Counter(r.symbol for r in chains.chains(plain, "impulse").collect())
    mean, n = sum(per.values()) / len(per), len(per)
    limit = mean + 2 * (sum((x - mean) ** 2 for x in per.values()) / (n - 1)) ** 0.5
    over = [(s, k) for s, k in sorted(per.items(), key=lambda x: (-x[1], x[0])) if k > limit]
    assert [tuple(r) for r in quality.over_represented(found, buckets=5).collect()] == over[:5]
    assert tables.short_series(bars) and tables.buckets_for(bars) == 4


def test_grown_chains_are_the_joined_ones(spark):
    """Later rounds begin with the new waves: the same chains as all joins with the first new wave at each place."""
    from pyspark.sql import functions as F

    from wavemill.operators import degrees

    bars = make_bars(spark, {f"walk{i}": series_of(i, 90, "walk") for i in range(3)})
    every = tables.kept(swings.monowaves(bars, 1).select(*tables.SERIES, "s", "e", "up", "low", "high", "turn", F.lit(1).alias("degree")).distinct(), 3)
    fresh = (F.col("s") * 7 + F.col("e")) % 4 == 0
    older, new = tables.kept(every.where(~fresh), 3), tables.kept(every.where(fresh), 3)
    for family, plan in [("corrective", chains.FAMILIES["corrective"])]:
        joined = [degrees.chained([older] * i + [new] + [every] * (len(plan) - 1 - i), family) for i in range(len(plan))]
        row = lambda r: repr((r.symbol, r.start, r.degree, r.rule_name, r.turn, r.waves))
        want = sorted(row(r) for part in joined for r in part.collect())
        assert sorted(map(row, degrees.grown(older, new, every, family).collect())) == want


def test_large_kept_tables_are_not_broadcast_for_their_small_files(spark):
    """Windows of a table of 1,200 short series: files of some KB, by which Spark would send all rows to the driver."""
    from pyspark.sql import functions as F

    from wavemill.operators import windows

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ids = spark.range(1200 * 40).select((F.col("id") % 1200).cast("string").alias("symbol"), F.lit("1wk").alias("interval"), F.floor(F.col("id") / 1200).cast("int").alias("bar_idx"))
    price = (F.hash("symbol", "bar_idx") % 50).cast("double")
    bars = tables.kept(ids.withColumns({"low": price, "high": price + 1}), 4)
    wide = tables.kept(ids.select(*tables.SERIES, F.col("bar_idx").alias("start_row"), F.least(F.lit(20), 40 - F.col("bar_idx")).alias("window_len")), 4)
    some = tables.kept(wide.where("symbol = '7'"), 4)
    both = wide.join(bars, (wide.symbol == bars.symbol) & (wide.start_row == bars.bar_idx))
    assert "BroadcastHashJoin" not in plan(both) and both.count() == 1200 * 40
    assert "BroadcastHashJoin" in plan(some.join(some.select(*tables.SERIES, "start_row"), [*tables.SERIES, "start_row"]))
    spans = lambda w: windows.lowest_in(bars, w.select(*tables.SERIES, "start_row", F.col("start_row").alias("first"), (F.col("start_row") + F.col("window_len") - 1).alias("last")))
    assert "BroadcastHashJoin" not in plan(spans(wide)) and spans(wide).count() == 1200 * 40
    few = spans(some).select("start_row", "lowest").collect()
    assert sorted(few) == sorted(spans(wide).where("symbol = '7'").select("start_row", "lowest").collect()) and len(few) == 40
