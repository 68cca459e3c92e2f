"""Storage: bucketed series, committed runs, documents of any shape."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from test_waves import make_bars

from wavemill.operators import ledger as L
from wavemill.operators import scan as P
from wavemill.sources import bars as I
from wavemill.sources import sinks


def test_bucketed_series_need_no_exchange(spark):
    bars = make_bars(spark, {name: [(1.0 + i, 2.0 + i) for i in range(9)] for name in "abcd"}).withColumn("bar_ts", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("bar_idx") + 1, F.lit(0), F.lit(0), F.lit(0)))
    sinks.write_series(bars, "some_series", 4)
    table = spark.table("some_series")
    moved = table.withColumn("before", F.lag("low").over(Window.partitionBy("symbol", "interval").orderBy("bar_ts")))
    both = moved.join(table.groupBy("symbol", "interval").agg(F.min("low").alias("least")).hint("merge"), ["symbol", "interval"])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert both.count() == 36 and {r.least for r in both.collect()} == {1.0}


RESULT = "symbol string, interval string, start_row int, ensemble_score double, error string"


def test_a_run_is_committed_once(spark, tmp_path):
    path = f"{tmp_path}/run"
    result = spark.createDataFrame([("a", "1d", 0, 0.5, None), ("a", "1d", 9, 0.7, None), ("b", "1d", 3, 0.9, None), ("b", "1d", None, None, "broken")], RESULT)
    every = spark.createDataFrame([("a", "1d"), ("b", "1d"), ("c", "1d")], "symbol string, interval string")
    assert L.ledger(spark, path).count() == 0 and L.committed(spark, path, "failures").count() == 0
    with pytest.raises(ValueError):
        L.committed(spark, path)
    L.stage(result, path, "one", every)  # lost before it got to the ledger
    row = L.commit_run(result, path, "one", every).collect()[0]
    assert (row.series, row.done, row.failed, row.patterns, row.best_score, row.per_series) == (3, 2, 1, 2, 0.7, 1.0)
    assert L.commit_run(result.limit(0), path, "one", every).collect() == [row]
    assert sorted(r.start_row for r in L.committed(spark, path).collect()) == [0, 9]
    assert [r.error for r in L.committed(spark, path, "failures").collect()] == ["broken"]
    assert [r.symbol for r in P.pending(every, L.done_series(spark, path)).collect()] == ["b"]
    again = spark.createDataFrame([("b", "1d", 3, 0.9, None)], RESULT)
    L.commit_run(again, path, "2/two", again)
    assert sorted(r.symbol for r in L.committed(spark, path).collect()) == ["a", "a", "b"] and L.ledger(spark, path).count() == 2
    assert P.pending(every, L.done_series(spark, path)).count() == 0
    L.commit_run(again.limit(0), path, "3", every.limit(0))  # a run that found nothing
    assert L.ledger(spark, path).where("run_id = '3'").collect()[0].patterns == 0


def test_a_committed_run_without_hits_is_its_sql(spark, tmp_path):
    import duckdb

    from wavemill.plans import queries, sql

    con = duckdb.connect()
    con.execute("create view nation as select i as n_nationkey, 'NATION_' || i as n_name from range(6, 8) t(i)")
    con.execute("create view supplier as select i as s_suppkey, i as s_nationkey from range(6, 8) t(i)")
    con.execute("create view lineitem as select i as l_orderkey, i as l_partkey, 6 + i % 2 as l_suppkey, 1 as l_linenumber, 2.0::double as l_quantity, 8.0::double as l_extendedprice, timestamp '1995-01-02' + interval 1 day * i as l_shipdate from range(250) t(i)")
    for name in ("nation", "supplier", "lineitem"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet'")
    got = queries.QUERIES["s13_committed_run"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(sql.ORACLE_SQL["s13_committed_run"]).fetchall()
    assert (got[0].patterns, got[0].hits_seen, got[0].attempts_seen) == (0, 0, 1)


def test_documents_of_several_shapes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, patterns in enumerate(([{"symbol": "A", "best": {"waves": {"wave1": {"low": 1.5}}}, "wave_config": [1, 2]}, {"symbol": 7}], [{"symbol": "B", "extra": [{"k": 1}], "best": "none"}], [])):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"metadata": {"i": i}, "patterns": patterns}, indent=1))
    (tmp_path / "in" / "9.json").write_text("{}")
    got = I.read_patterns(spark, f"{tmp_path}/in", {"symbol": "string", "best.waves.wave1.low": "double", "wave_config": "array<int>", "extra[0].k": "int"})
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("A", 1.5, [1, 2], None), ("7", None, None, None), ("B", None, None, 1)], key=str)
    assert I.read_patterns(spark, f"{tmp_path}/in").where("symbol = 'A'").select("wave_config").first()[0] == [1, 2]
