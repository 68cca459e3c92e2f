"""Backtest of patterns against bars. Bars are indexed (bar_idx) and dated (bar_ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import nearest, running


def asof_price(events: DataFrame, bars: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Adds entry_idx, entry_ts and entry_price of the first bar at or after the event, or the last bar. Events and bars
    are scanned together in range partitions, so that no event meets more than one bar and a symbol's bars are spread
    over tasks. Events of symbols without bars are left out."""
    e = events.withColumn("_row", F.struct(*events.columns)).select("symbol", F.col(ts_col).alias("_t"), F.lit(0).alias("_bar"), "_row", F.lit(None).cast("struct<bar_idx:int,bar_ts:timestamp_ntz,close:double>").alias("_b"))
    b = bars.select("symbol", F.col("bar_ts").alias("_t"), F.lit(1).alias("_bar"), F.lit(None).cast(e.schema["_row"].dataType).alias("_row"), F.struct("bar_idx", "bar_ts", "close").alias("_b"))
    both = nearest(e.unionByName(b), ["symbol"], ["_t", "_bar"], "_b").withColumn("_hit", F.coalesce("_ahead", "_behind"))
    got = both.where("_bar = 0 and _hit is not null")
    return got.select("_row.*", F.col("_hit.bar_idx").alias("entry_idx"), F.col("_hit.bar_ts").alias("entry_ts"), F.col("_hit.close").alias("entry_price"))


def simulate_trades(patterns: DataFrame, bars: DataFrame, hold: int = 20, stop: float = 0.05, take: float = 0.1, size: float = 1000.0, entry_index: str = "asof") -> DataFrame:
    """A long trade per pattern but corrections: in at the close at date_end; out at the first of the next hold bars
    whose high takes the profit (checked first) or whose low hits the stop, else at the last of them. With
    entry_index="first", an entry day that is no bar counts its bars from the series' start."""
    p = patterns.where(F.lower("rule_name") != "corrective")
    e = asof_price(p, bars, "date_end")
    if entry_index == "first":
        e = e.withColumn("entry_idx", F.when(F.to_date("entry_ts") == F.to_date("date_end"), F.col("entry_idx")).otherwise(0))
    b = bars.select("symbol", "bar_idx", F.col("bar_ts").alias("_ts"), "high", "low", "close")
    # a trade meets the bars that it holds, not all of its symbol's
    held = e.withColumn("bar_idx", F.explode(F.sequence(F.col("entry_idx") + 1, F.col("entry_idx") + hold))).join(b, ["symbol", "bar_idx"])
    goal, floor = F.col("entry_price") * (1 + take), F.col("entry_price") * (1 - stop)
    price = F.when(F.col("high") >= goal, goal).when(F.col("low") <= floor, floor)
    keys = ["symbol", "rule_name", "start", "date_start", "date_end", "ensemble_score", "entry_idx", "entry_ts", "entry_price"]
    out = held.groupBy(*keys).agg(
        F.min_by(F.struct("bar_idx", F.col("_ts").alias("ts"), price.alias("price")), F.when(price.isNotNull(), F.col("bar_idx"))).alias("hit"),
        F.max_by(F.struct("bar_idx", F.col("_ts").alias("ts"), F.col("close").alias("price")), "bar_idx").alias("last"),
    ).withColumn("exit", F.coalesce("hit", "last"))
    ret = F.col("exit.price") / F.col("entry_price") - 1
    return out.select(
        "symbol", "rule_name", "start", "ensemble_score", F.col("entry_ts").alias("entry_date"), F.col("exit.ts").alias("exit_date"), "entry_price", F.col("exit.price").alias("exit_price"),
        F.lit(size).alias("position_size"), (100 * ret).alias("return_pct"), (size * ret).alias("profit_loss"),
    )


def backtest_metrics(trades: DataFrame) -> DataFrame:
    pl, r = F.col("profit_loss"), F.col("return_pct")
    gain, loss = F.coalesce(F.sum(F.when(pl > 0, pl)), F.lit(0.0)), F.coalesce(F.sum(F.when(pl < 0, -pl)), F.lit(0.0))
    days = F.date_diff(F.to_date("exit_date"), F.to_date("entry_date"))
    return trades.agg(
        F.count("*").alias("trades"), F.count_if(pl > 0).alias("wins"), F.count_if(pl <= 0).alias("losses"), (100 * F.avg((pl > 0).cast("double"))).alias("win_rate"), F.sum(r).alias("total_return"), F.avg(r).alias("mean_return"),
        F.median(r).alias("median_return"), F.max(r).alias("max_return"), F.min(r).alias("min_return"), F.when(loss > 0, gain / loss).otherwise(F.lit(float("inf"))).alias("profit_factor"), gain.alias("gross_profit"), loss.alias("gross_loss"), F.avg(days).alias("mean_days"),
    )


def sharpe(trades: DataFrame, risk_free: float = 0.02) -> DataFrame:
    """Of daily-scaled returns: sqrt(252) * mean excess / population deviation; 0 for fewer than two trades or no spread."""
    r = F.col("return_pct") / 100
    return trades.agg(F.when((F.count("*") < 2) | (F.stddev_pop(r) == 0), 0.0).otherwise(F.sqrt(F.lit(252.0)) * (F.avg(r) - risk_free / 252) / F.stddev_pop(r)).alias("sharpe"))


def max_drawdown(trades: DataFrame, group: str = "symbol", order_cols: tuple[str, ...] = ("start", "rule_name")) -> DataFrame:
    """Of the equity that starts at the first position's size and adds profits in trade order: groups in order, trades in
    order within a group. A scan over range partitions: no task takes a group's, let alone all, trades."""
    order = [group, *order_cols]
    start = trades.agg(F.min_by("position_size", F.struct(*order)).alias("_start"))
    t = running(trades.select(*order, "profit_loss"), order, F.col("profit_loss")).crossJoin(F.broadcast(start))  # one row
    peak, equity = F.col("_start") + F.col("_top"), F.col("_start") + F.col("_sum")
    return t.agg(F.coalesce(F.max((peak - equity) / peak), F.lit(0.0)).alias("max_drawdown"))


def top_trades(trades: DataFrame, n: int = 5) -> DataFrame:
    """The n best and the n worst."""
    key = ["symbol", "rule_name", "start"]
    best = trades.orderBy(F.desc("return_pct"), *key).limit(n).withColumn("side", F.lit("best"))
    return best.union(trades.orderBy("return_pct", *key).limit(n).withColumn("side", F.lit("worst"))).select("side", *key, "return_pct")


def price_ranges(patterns: DataFrame, hold: int = 20) -> DataFrame:
    """Per symbol, the days of prices that its trades need."""
    return patterns.groupBy("symbol").agg(F.min(F.to_date("date_start")).alias("first_day"), F.date_add(F.max(F.to_date("date_end")), hold + 30).alias("last_day"))
