"""SimHash near-duplicates by multi-index hashing, and the components that the links make.

Fingerprints are 64-bit majorities over the XXH64 hashes of a text's 3-word shingles. Equal
fingerprints are one node. Of two nodes that differ in two bits at most, either the high halves differ
in one bit at most or the low halves are equal. So each node enumerates the Hamming ball of radius 1
around its high half (33 values) and of radius 0 around its low half, fetches the nodes that have such
a half from the table of halves, and keeps those at a complete distance of two or less. A node has
2,080 such neighbours at most, whatever the size of a group of copies, as exact copies are one node. A half that more
than HOT nodes share is not fetched from: nodes that would ask for it look all of their 2,080 neighbours up by whole
fingerprint, so that no half makes pairs by the square of its nodes.
Components come from alternating large-star and small-star rounds over the links.

Cases: a null text is the empty text; texts without words have fingerprint zero, which links like any
other. Repeated rows and repeated ids get one output row each. A null id gets its fingerprint and its
group's smallest id, which is null where no member has an id. Other columns are ignored. An empty
table gives an empty result. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices, small_batches

SEED, WORDS = 42, 3
#: More nodes than that share a hot half.
HOT = 2080
BYTES = np.arange(256, dtype=np.int64)[:, None] >> np.arange(8) & 1


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text: words between white space, ASCII letters in lower case."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: n - WORDS + 1].tolist()
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)], "<u8", n - WORDS + 1)
    octets, out = hashes.view(np.uint8).reshape(-1, 8), 0
    for i in range(8):
        ones = np.bincount(octets[:, i], minlength=256) @ BYTES
        out |= sum(1 << (8 * i + j) for j in np.flatnonzero(2 * ones > len(hashes)).tolist())
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and text_hash of every document."""
    thin = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [fingerprint(text) for text in part.column(1).cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), fp, part.column(2)], names=["doc_id", "fp", "text_hash"])

    return thin.mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, fp bigint, text_hash bigint")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs u < v of the fp values that differ in two bits at most."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    table = nodes.select(F.col("fp").alias("v"), F.explode(F.array(F.struct(F.lit(0).alias("half"), high.alias("value")), F.struct(F.lit(1).alias("half"), low.alias("value")))).alias("at"))
    around = F.transform(ball, lambda x: F.struct(F.lit(0).alias("half"), high.bitwiseXOR(x).alias("value")))
    probes = nodes.select(F.col("fp").alias("u"), F.explode(F.concat(around, F.array(F.struct(F.lit(1).alias("half"), low.alias("value"))))).alias("at"))
    key = ["half", "value"]
    probes = probes.select("u", "at.*")
    table = table.select("v", "at.*")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    # each node finds all of its links, so a pair is found from both of its ends, and asking for u < v loses none
    hot = table.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*key)
    if not hot.limit(1).count():
        return probes.join(table, key).where(near).select("u", "v").distinct()
    asks = probes.join(hot, key, "left_semi").select("u").distinct().checkpoint()
    found = probes.join(asks, "u", "left_anti").join(table, key).where(near).select("u", "v")
    bit = lambda i: F.when(i < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, i)" if i is first else "shiftleft(1L, j)"))
    first, second = F.col("i"), F.col("j")
    ball = asks.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(62)))).withColumn("j", F.explode(F.sequence(F.when(first < 0, F.lit(0)).otherwise(first + 1), F.lit(63))))
    ball = ball.select("u", F.col("u").bitwiseXOR(bit(first).bitwiseXOR(bit(second))).alias("v"))
    looked_up = ball.where("u < v").join(nodes.select(F.col("fp").alias("v")), "v").select("u", "v")
    return found.union(looked_up).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """u and root, the least node that u is connected with, for each node of the edges (u, v) but the
    roots themselves. Each round's edges go to the shared checkpoint folder; the number of rounds grows
    with the logarithm of the longest chain."""
    shared_dir(edges.sparkSession)

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = edges.checkpoint()
    was = state(edges)
    for _ in range(most_rounds):
        edges = small_star(large_star(edges)).checkpoint()
        if (now := state(edges)) == was:
            return edges.select("u", F.col("v").alias("root"))
        was = now
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def with_roots(nodes: DataFrame) -> DataFrame:
    """The nodes (fp and other columns) with the least fp of their component."""
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots, nodes.fp == roots.u, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest
    id that it is linked with, over any number of links, itself included)."""
    shared_dir(docs.sparkSession)
    thin = fingerprints(docs, id_col, text_col).drop("text_hash").checkpoint()  # 16 bytes a document, read three times
    of = with_roots(thin.groupBy("fp").agg(F.min("doc_id").alias("least")))
    whole = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(whole, "root").select("fp", "component_id")
    return thin.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document of the smallest id (then text hash), with all columns; one row of rows
    that share id and text. Rows without an id do not stand in for rows with one, nor the other way round:
    a component keeps one of each kind."""
    shared_dir(docs.sparkSession)
    key = "row"
    while key in docs.columns:
        key += "_"
    row = lambda id_, text_hash: F.struct(id_.alias("id"), text_hash.alias("text_hash"))  # noqa: E731 (null ids in a struct are equal)
    thin = fingerprints(docs, id_col, text_col)
    # the least row of each fingerprint and kind: a fingerprint is of one component
    least = thin.groupBy("fp", F.col("doc_id").isNull().alias("no_id")).agg(F.min(row(F.col("doc_id"), F.col("text_hash"))).alias(key)).checkpoint()
    of = with_roots(least.select("fp").distinct())
    keep = least.join(of, "fp").groupBy("root", "no_id").agg(F.min(key).alias(key)).select(key)
    # copies go in the partial aggregation, before the shuffle, which the join shares
    first = docs.withColumn(key, row(F.col(id_col), F.xxhash64(text_col))).dropDuplicates([key])
    return first.join(keep, key, "left_semi").select(docs.columns)
