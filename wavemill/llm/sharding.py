"""Shards of bounded size by extendible hashing.

A document's address is 60 bits of a hash of its id. A bucket is an address prefix; a bucket over the
byte limit that holds more than one document is split on the next bit, all others stay as they are.
The trie of prefixes is summed from the cells of one prefix length, so the documents are counted once
and joined once with the directory (cell -> bucket), both of which are shuffled by cell. Documents of a
cell that is still too large go on alone, LEVELS bits deeper.

Rows that share an address (a repeated id) cannot be told apart by bits. What is too large after the
last bit gets overflow pages, the bucket chain of extendible hashing: each input partition fills pages
of its own up to the limit, so no task has to hold such a bucket.

Cases: a null text counts no bytes, a null id has the address of the empty string; every row gets a
shard. A document over the limit ends up in a shard of its own, the only kind of shard that is over.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir

BITS, LEVELS = 60, 8
LIMIT = 16 << 20
#: Bits of the trie that are walked at once; up to so many bits, a table of prefixes (2^16 rows at most) is broadcast.
STRIDE, FEW_BITS = 8, 16


def address(id_text: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text, which any engine can compute."""
    return F.conv(F.substring(F.md5(F.coalesce(id_text, F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(depth: Column | int) -> Column:
    return F.lpad(F.bin("address"), BITS, "0").substr(F.lit(1), F.lit(depth) if isinstance(depth, int) else depth)


def buckets(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell (address prefix of high bits) and its bucket: depth, from low to high, shard_bytes, shard_docs.
    Buckets at depth high may be too large. The trie is walked STRIDE bits at a time from the top, and a stride
    sees only what the one above split: no prefix meets more than 2^STRIDE others in a task."""
    rest = rows.groupBy(F.shiftright("address", BITS - high).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).checkpoint()
    parts = []
    for top in range(low, high + 1, STRIDE):
        bottom = min(high, top + STRIDE - 1)
        base = F.shiftright("cell", high - bottom).alias("base")
        bases = rest.groupBy(base).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        paths = bases.select("base", "b", "n", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth")).withColumn("node", F.expr(f"shiftright(base, {bottom} - depth)"))
        nodes = paths.groupBy("depth", "node").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        done = nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == high))
        # a base's bucket is the shallowest prefix that needs no split
        found = paths.select("base", "depth", "node").join(done, ["depth", "node"]).groupBy("base").agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("bucket")).checkpoint()
        # a prefix of few bits has few values, each with many cells: those are broadcast
        found = F.broadcast(found) if bottom <= FEW_BITS else found
        parts.append(rest.withColumn("base", base).join(found, "base").select("cell", "bucket.*"))
        if bottom < high:
            rest = rest.withColumn("base", base).join(found, "base", "left_anti").select("cell", "b", "n").checkpoint()
    return reduce(DataFrame.unionByName, parts)


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (its address prefix, with .partition.page added on
    overflow pages), depth, shard_bytes, shard_docs."""
    return placed(docs, limit, id_col, text_col, [])


def placed(docs: DataFrame, limit: int, id_col: str, text_col: str, carried: list[Column]) -> DataFrame:
    """The columns of assign, and the carried ones."""
    shared_dir(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        address(F.col(id_col).cast("string")).alias("address"), F.spark_partition_id().alias("part"), *carried,
    )
    more = rows.columns[4:]
    total, n = rows.agg(F.sum("n_bytes"), F.count("*")).first()
    parts, low, high = [], 0, min(BITS, LEVELS + max(0, ceil(log2(max(1, (total or 0) / limit)))))
    while n:
        found = rows.withColumn("cell", F.shiftright("address", BITS - high)).join(buckets(rows, low, high, limit), "cell").drop("cell")
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
        parts.append(found.where(fits).withColumn("shard", prefix(F.col("depth"))))
        rows = found.where(~fits).select("doc_id", "n_bytes", "address", "part", *more).checkpoint()
        if not (n := rows.count()) or high == BITS:
            break
        low, high = high + 1, min(BITS, high + LEVELS)
    if n:
        parts.append(overflow(rows, limit))
    columns = ["doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", *more]
    if not parts:
        return rows.select("doc_id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"), *more)
    return reduce(DataFrame.unionByName, [part.select(columns) for part in parts])


def overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one address over the limit, on pages. Each of the rows fits the limit or has a page of its
    own; rows of at most half the limit are dealt by their running sum in half-limit steps, so that a
    page, with the row that crosses its end, stays within the limit."""
    order = Window.partitionBy("address", "part").orderBy("n_bytes", F.expr("doc_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = max(1, limit // 2)
    large = F.col("n_bytes") > half
    page = F.when(large, F.concat(F.lit("r"), F.sum(F.lit(1)).over(order))).otherwise(F.floor((F.sum("n_bytes").over(order) - 1) / half).cast("string"))
    paged = rows.withColumn("page", page).withColumn("shard", F.concat_ws(".", prefix(BITS), F.col("part"), F.col("page"))).checkpoint()
    sizes = paged.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return paged.join(sizes, "shard").withColumn("depth", F.lit(BITS))


def write(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents, all columns and their shard (shard_, if the name is taken), as one Parquet folder
    per shard. Rows go with their shards, so repeated ids stay one row each."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    found = placed(docs, limit, id_col, text_col, [F.struct(*docs.columns).alias("row")])
    found.select("row.*", F.col("shard").alias(name)).repartition(F.col(name)).write.partitionBy(name).parquet(path)


def sql(limit: int = LIMIT, deepest: int = 40) -> str:
    """The same for unique ids whose buckets fit within that many bits."""
    return f"""
WITH rows AS (
    SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents
), nodes AS (
    SELECT depth, bits[1:depth] AS shard, sum(n_bytes) AS b, count(*) AS n FROM rows, range(0, {deepest + 1}) AS t(depth) GROUP BY ALL
), found AS (
    SELECT doc_id, n_bytes, min(depth) AS depth FROM rows, nodes WHERE bits[1:depth] = shard AND (b <= {limit} OR n = 1) GROUP BY doc_id, n_bytes, bits
)
SELECT f.doc_id, f.n_bytes, r.bits[1:f.depth] AS shard, CAST(f.depth AS INTEGER) AS depth, CAST(n.b AS BIGINT) AS shard_bytes, n.n AS shard_docs
FROM found f JOIN rows r USING (doc_id) JOIN nodes n ON n.depth = f.depth AND n.shard = r.bits[1:f.depth]
"""
