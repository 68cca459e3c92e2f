"""Readers: bars, symbols, manifests and stored patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted column names, first match wins, in lower case.
NAMES = {
    "bar_ts": ("datetime", "date", "timestamp", "bar_ts", "ts"), "symbol": ("ticker", "symbol", "tickers", "ticker_symbol"), "open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",),
    "volume": ("volume",), "interval": ("interval",), "source_category": ("source_category",),
}
INTERVALS = ("1h", "4h", "1d", "1wk")
#: How many days of history an interval may have; others have no cap.
HISTORY_DAYS = {"1m": 7, "2m": 60, "5m": 60, "15m": 60, "30m": 60, "90m": 60, "60m": 730, "1h": 730, "4h": 730}
#: The fields of stored patterns that are read if none are named.
PATTERN_FIELDS = {
    "symbol": "string", "interval": "string", "start": "int", "start_row": "int", "window_len": "int", "date_start": "string", "date_end": "string", "rule_name": "string", "score": "double",
    "wave_config": "array<int>", "waves": "variant", "best": "variant", "ensemble_score": "double", "fib_score": "double",
}
MANIFEST = "markets map<string,map<string,struct<rows:bigint,min_date:string,max_date:string>>>, failures map<string,map<string,string>>"


def normalize_bars(df: DataFrame) -> DataFrame:
    """Bars under their own names and types, from columns of any case; refuses a table without times or prices."""
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[c] for c in options if c in have), None) for name, options in NAMES.items()}
    if missing := [n for n in ("bar_ts", "open", "high", "low", "close") if not found[n]]:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    kinds = {"bar_ts": "timestamp_ntz", "symbol": "string", "interval": "string", "source_category": "string"}
    return df.select(*[F.col(f"`{c}`").cast(kinds.get(name, "double")).alias(name) for name, c in found.items() if c])


def read_bars(spark: SparkSession, folder: str, interval: str) -> DataFrame:
    """One interval's file of a folder."""
    df = normalize_bars(spark.read.parquet(f"{folder}/market_data_{interval}.parquet"))
    return df if "interval" in df.columns else df.withColumn("interval", F.lit(interval))


def combine_bars(spark: SparkSession, folders: list[str]) -> DataFrame:
    """All Parquet files below the folders. The interval is the first of INTERVALS in the name of the file, or of the
    .parquet folder that it is part of, where the table has none; the category is the name of the parent folder."""

    def one(folder: str) -> DataFrame:
        raw = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(folder).select("*", F.col("_metadata.file_path").alias("_path"))
        part = lambda i: F.coalesce(F.try_element_at(F.split("_path", "/"), F.lit(i)), F.lit(""))
        within = part(-2).endswith(".parquet")
        name, parent = F.when(within, part(-2)).otherwise(part(-1)), F.when(within, part(-3)).otherwise(part(-2))
        interval = F.coalesce(*[F.when(name.contains(i), F.lit(i)) for i in INTERVALS])
        have = {c.lower() for c in raw.columns}
        if "interval" not in have:
            raw = raw.withColumn("interval", interval)
        if "source_category" not in have:
            raw = raw.withColumn("source_category", parent)
        return normalize_bars(raw.drop("_path"))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, folders))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """One symbol a line; blanks are trimmed, empty lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("symbol")).where(F.length("symbol") > 0)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(market, ticker, rows, min_date, max_date) and (market, ticker, reason) of a manifest in JSON."""
    raw = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    markets = raw.select(F.explode("markets").alias("market", "t")).select("market", F.explode("t").alias("ticker", "v")).select("market", "ticker", "v.*")
    failures = raw.select(F.explode("failures").alias("market", "t")).select("market", F.explode("t").alias("ticker", "reason"))
    return markets, failures


def pattern_documents(spark: SparkSession, path: str) -> DataFrame:
    """metadata and pattern of each pattern of the documents under path, both VARIANT: read once, whatever their shape, and the
    shape may differ from document to document."""
    docs = spark.read.option("singleVariantColumn", "doc").option("multiLine", "true").json(path)
    each = docs.lateralJoin(spark.tvf.variant_explode(F.variant_get(F.col("doc").outer(), "$.patterns", "variant")))
    return each.select(F.try_variant_get("doc", F.lit("$.metadata"), "variant").alias("metadata"), F.col("value").alias("pattern"))


def read_patterns(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """Fields of the patterns of such documents, by name or path below the pattern ("best.waves.wave1.low") and type; null
    where a pattern has none, or one of another kind."""
    found = pattern_documents(spark, path)
    return found.select(*[F.try_variant_get("pattern", F.lit(f"$.{name}"), kind).alias(name.replace(".", "_")) for name, kind in (fields or PATTERN_FIELDS).items()])


def select_symbols(df: DataFrame, symbols: list[str] | DataFrame) -> DataFrame:
    """A few symbols as a filter that reaches the scan, a table of symbols as a semi-join."""
    return df.where(F.col("symbol").isin(symbols)) if isinstance(symbols, list) else df.join(symbols.select("symbol"), "symbol", "left_semi")


def last_days(df: DataFrame, n: int, as_of: str) -> DataFrame:
    """The last n days up to as_of; all for n of zero or less."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return df if n <= 0 else df.where((F.col("bar_ts") >= end - F.make_dt_interval(F.lit(n))) & (F.col("bar_ts") <= end))


def cap_history(df: DataFrame, as_of: str) -> DataFrame:
    """At most HISTORY_DAYS of each interval."""
    days = F.lit(None).cast("int")
    for interval, n in HISTORY_DAYS.items():
        days = F.when(F.col("interval") == interval, F.lit(n)).otherwise(days)
    return df.where(days.isNull() | (F.col("bar_ts") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days)))


def filter_patterns(df: DataFrame, min_score: float | None = None, symbol: str | None = None, rule_name: str | None = None) -> DataFrame:
    """Patterns by score, symbol and rule (in any case)."""
    if min_score is not None:
        df = df.where(F.col("ensemble_score") >= min_score)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    return df if rule_name is None else df.where(F.lower("rule_name") == rule_name.lower())
