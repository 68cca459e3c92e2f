"""MinHash near-duplicates with HyperMinHash registers, exact links and the components that they make.

A document's set is that of its 5-word shingles, as 64-bit hashes. Each shingle falls into one of BANDS * ROWS buckets;
a bucket's register keeps the least hash of its shingles compressed to 16 bits: the number of leading zeros (plus one) and
the MANTISSA bits after the leading one. Documents of equal sets are one node. Nodes meet in the buckets of bands (ROWS
registers are equal; bands without any shingle do not count). A pair of Jaccard similarity s meets in at least one
band with a chance of 1 - (1 - s^ROWS)^BANDS or more: at the threshold of 0.85, one pair in four million is missed.

What meets is compared in two turns, so that a large group of near copies does not cost its square. First, each band
bucket's most central node (that of most meetings) is compared with the others: a group around an original becomes
one component by as many comparisons as it has nodes. Then the nodes of buckets that still hold several components are
compared across components, in blocks of bounded size. A comparison estimates the similarity from the registers first,
corrected for registers that are equal by compression alone, and leaves out what is MARGIN deviations below
the threshold; the rest is confirmed on the whole sets. Within a block, what is connected already is not confirmed again,
so a block of m nodes yields m - 1 links at most.

Buckets and centres that more than 1 in 10,000 of the rows share (at most 10,000 of them at any size) are joined in salted
parts; the list of them is what is broadcast. What is square: the nodes of a band bucket that do not link with its
centre, in blocks of numpy comparisons, not as rows.

Cases: null texts and texts without words have no shingles and are linked with nothing; of fewer than five words, the
whole sequence is the one shingle. Repeated rows and ids get one output row each. A row without an id is linked like others, but
names no component; kept says whether the row's id is the component's (for both null, too). Other columns are ignored. An
empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, shared_dir, slices, small_batches, written
from .simhash import components

WORDS = 5
#: Linked from a similarity of so many hundredths.
PERCENT = 85
BANDS, ROWS = 32, 6
BUCKETS = BANDS * ROWS
#: Bits of a hash below those that choose its bucket, and bits that are kept after the leading one.
VALUE, MANTISSA = 40, 10
#: Deviations of an estimate below the threshold at which a pair is left out.
MARGIN = 5.0
#: Bits of the bitmap of wanted texts.
BITS = 1 << 25
#: Nodes and shingles of one side of a comparison.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Pairs whose registers are compared at a time.
PAIRS = 1 << 15
MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: bytes, words: WordHashes, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h += w[i : len(w) - size + 1 + i] * MULTIPLIERS[i]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # a mixer, as sums have weak low bits
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return np.unique(h ^ (h >> np.uint64(31)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed least hash of each bucket, 0 for empty ones."""
    bucket = ((hashes >> np.uint64(VALUE)) * np.uint64(BUCKETS)) >> np.uint64(64 - VALUE)
    value = (hashes & np.uint64((1 << VALUE) - 1)).astype(np.int64)
    least = np.full(BUCKETS, 1 << VALUE, np.int64)
    np.minimum.at(least, bucket.astype(np.int64), value)
    length = np.frexp(np.maximum(least, 1).astype(np.float64))[1].astype(np.int64)  # exact below 2^53
    rest = least - (np.int64(1) << (length - 1))
    mantissa = np.where(length - 1 >= MANTISSA, rest >> np.maximum(length - 1 - MANTISSA, 0), rest << np.maximum(MANTISSA - length + 1, 0))
    code = ((VALUE - length + 1) << MANTISSA) | np.maximum(mantissa, 0)
    return np.where(least == 1 << VALUE, 0, code).astype("<u2")


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that different least hashes have one code. Of two exponential minima of rates a and b, the densities
    meet in a bin of relative width d with chance d * ab / (a + b)^2; a bin is 1 / (2 ln 2) / 2^MANTISSA wide on average."""
    return n * m / (n + m) ** 2 / (2 * np.log(2)) / 2**MANTISSA


def estimated(same: np.ndarray, filled: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity from equal registers of those that either side fills, corrected, and a bound that its deviation keeps."""
    chance = by_chance(n, m)
    filled = np.maximum(filled, 1)
    t = PERCENT / 100
    return (same / filled - chance) / (1 - chance), MARGIN * np.sqrt(t * (1 - t) / filled) + 1 / filled


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n (shingles), key (of the set, null if it is empty) and regs of every document."""
    thin = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.md5(F.col(text_col)).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in slices(batches):
            n, key, regs = [], [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                found = shingles(text, words)
                n.append(len(found))
                key.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                regs.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "text_hash", "n", "key", "regs"])

    return thin.mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, text_hash string, n long, key binary, regs binary")


def in_bands(nodes: DataFrame) -> DataFrame:
    """value (of the band and its registers) and node of each node and band that has a shingle, with the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, BANDS, ROWS)
            at, band = np.nonzero(regs.any(axis=2))
            value = [xxhash.xxh64_intdigest(regs[i, j].tobytes(), j) for i, j in zip(at.tolist(), band.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(value, np.uint64).view(np.int64)), batch.column(0).take(pa.array(at)), pa.array(band.astype(np.int8))], names=["value", "node", "band"])

    return small_batches(nodes).select("node", "regs").mapInArrow(run, "value long, node long, band tinyint")


def in_parts(rows: DataFrame, keys: list[str], others: DataFrame, spread: Column, counts: DataFrame | None = None) -> DataFrame:
    """The inner join of rows with others (one row a key). Keys that more than 1 in 10,000 of the rows have go in parts: the
    rows by spread, the others once for each part. There are at most 10,000 such keys, whatever the size. counts: how
    many rows each key has (_n), if known; keys may be missing that have none in others."""
    per = counts if counts is not None else rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    each = max(1024, ceil(rows.count() / 10_000))
    hot = F.broadcast(per.where(F.col("_n") > each).select(*keys, F.ceil(F.col("_n") / each).cast("int").alias("_parts")))
    left = rows.join(hot, keys, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts"))).cast("int"))
    right = others.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [*keys, "_part"]).drop("_part")


class Forest:
    """Components, by their names."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def link(self, x: int, y: int) -> None:
        self.above[self.root(x)] = self.root(y)


def in_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """run(table, first) for tables of whole groups in order of the keys, with the places where groups begin: many small
    groups at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            first = begins(table)
            if first[-1]:
                yield from run(table.slice(0, int(first[-1])), first[:-1]).to_batches()
            rest = table.slice(int(first[-1]))
        if rest is not None:
            yield from run(rest.combine_chunks(), np.zeros(1, np.int64)).to_batches()

    def begins(table: pa.Table) -> np.ndarray:
        g = table["g"].combine_chunks()
        return np.r_[0, np.flatnonzero(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)) + 1]

    return small_batches(rows).repartition("g").sortWithinPartitions(*keys).mapInArrow(each, schema)


def near_pairs(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of each group's two sides (or within its only side) whose components differ, whose sizes allow a
    link and whose registers say that they may be linked, likeliest first; pairs that met in an earlier band are left out,
    and those that this cell is not for (none of the two is its own). Rows are in order of group and side."""
    regs = np.frombuffer(b"".join(table["regs"].to_pylist()), "<u2").reshape(-1, BUCKETS)
    n, side, comp, own, band = (table[c].to_numpy() for c in ("n", "side", "comp", "own", "band"))
    sizes = np.diff(np.r_[first, len(n)])
    group = np.repeat(np.arange(len(first)), sizes)
    left = np.flatnonzero(side == 0)
    begin1 = first + np.add.reduceat(side == 0, first)  # where a group's second side begins
    end = (first + sizes)[group[left]]
    start = np.where(begin1[group[left]] < end, begin1[group[left]], left + 1)
    counts = end - start
    found = [np.zeros((3, 0))]
    ends = np.cumsum(counts)
    for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        at = np.arange(a, min(a + PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, at, side="right")
        i = left[row]
        j = start[row] + at - (ends[row] - counts[row])
        some = (comp[i] != comp[j]) & (own[i] | own[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        i, j = i[some], j[some]
        x, y = regs[i], regs[j]
        filled = (x > 0) | (y > 0)
        equal = x == y
        likely, margin = estimated((equal & filled).sum(axis=1), filled.sum(axis=1), n[i], n[j])
        keep = np.flatnonzero(likely >= PERCENT / 100 - margin)
        met = (equal[keep].reshape(-1, BANDS, ROWS).all(axis=2) & filled[keep].reshape(-1, BANDS, ROWS).any(axis=2)) & (np.arange(BANDS) < band[i[keep]][:, None])
        keep = keep[~met.any(axis=1)]
        found.append(np.stack([i[keep], j[keep], -likely[keep]]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.argsort(pairs[2], kind="stable")]
    return pairs[0].astype(np.int64), pairs[1].astype(np.int64)


def compare(groups: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """u, v: links of groups (g, band, side, own, node, comp). Registers travel first; whole sets are made, and travel, only for
    the members of pairs that the registers leave over."""
    kind = "g string, band tinyint, side tinyint, own boolean, node long, comp long"
    names = [c.split()[0] for c in kind.split(", ")]

    def likely(table: pa.Table, first: np.ndarray) -> pa.Table:
        a, b = near_pairs(table, first)
        return table.select(names).take(pa.array(np.unique(np.concatenate([a, b]))))

    met = groups.join(nodes.select("node", "n", "regs"), "node").select(*names, "n", "regs")
    left = written(in_groups(met, ["g", "side"], likely, kind))
    sets = whole_sets(docs, nodes.join(left.select("node").distinct(), "node", "left_semi"), text_col)

    def confirmed(table: pa.Table, first: np.ndarray) -> pa.Table:
        held = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
        table = table.append_column("n", pa.array([len(x) for x in held], pa.int64())).append_column("regs", pa.array([registers(x).tobytes() for x in held], pa.binary()))
        nodes, comps, forest, out = table["node"].to_pylist(), table["comp"].to_pylist(), Forest(), []
        for i, j in zip(*(x.tolist() for x in near_pairs(table, first)), strict=True):
            if forest.root(comps[i]) == forest.root(comps[j]):
                continue
            x, y = held[i], held[j]
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                forest.link(comps[i], comps[j])
                out.append(sorted((nodes[i], nodes[j])))
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return in_groups(left.join(sets, "node").select(*names, "hashes"), ["g", "side"], confirmed, "u long, v long").distinct()


def whole_sets(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """node and hashes (of the whole set) of the wanted nodes (node, text_hash). A bitmap of fixed size over the wanted texts' hashes
    keeps most other texts from the shuffle; it decides nothing."""
    at = lambda text_hash: F.pmod(F.xxhash64(text_hash), F.lit(BITS))
    bits = wanted.select(at(F.col("text_hash")).alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    texts = small_batches(docs).select(F.md5(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.withColumn("at", at(F.col("text_hash"))).withColumn("bucket", F.expr("bitmap_bucket_number(at)")).withColumn("spot", F.expr("cast(bitmap_bit_position(at) as int)"))
    byte = F.conv(F.hex(F.substring("bits", F.expr("spot div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    texts = texts.join(F.broadcast(bits), "bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, spot % 8)")) > 0).select("text_hash", "text")  # 1,024 rows of 4 KB
    # copies go in the partial aggregation, before the shuffle, which the join shares
    texts = texts.dropDuplicates(["text_hash"]).join(wanted.select("text_hash", "node"), "text_hash").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in slices(batches):
            found = [shingles(text, words).tobytes() for text in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def similar_size(n: str, m: str) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def links(docs: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """u, v: enough of the nodes' links to connect what is connected. nodes: node, text_hash, n, regs."""
    bands = in_bands(nodes)
    buckets = written(bands.groupBy("value").agg(F.count("*").alias("m")).where("m > 1"))
    counts = buckets.withColumnRenamed("m", "_n")
    members = written(in_parts(bands, ["value"], buckets, F.col("node"), counts))

    # first turn: the most central node of each bucket
    central = members.groupBy("node").agg(F.sum("m").alias("meetings")).join(nodes.select("node", "n"), "node")
    members = written(members.drop("m").join(central, "node"))
    centres = members.groupBy("value").agg(F.max(F.struct("meetings", "node", "n")).alias("c")).select("value", F.col("c.node").alias("centre"), F.col("c.n").alias("of_n"))
    pairs = in_parts(members, ["value"], centres, F.col("node"), counts).where((F.col("node") != F.col("centre")) & similar_size("n", "of_n"))
    pairs = written(pairs.select("centre", "node", "n").distinct())
    size = pairs.groupBy("centre").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    g = F.concat_ws(":", *[F.col(c).cast("string") for c in ("centre", "part")]).alias("g")
    dealt = in_parts(pairs, ["centre"], size, F.col("node")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    hubs = size.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = F.lit(0).cast("tinyint").alias("band")
    side = lambda i: F.lit(i).cast("tinyint").alias("side")
    own = F.lit(True).alias("own")
    groups = dealt.select(g, first, side(1), own, "node", F.col("node").alias("comp")).unionByName(hubs.select(g, first, side(0), own, F.col("centre").alias("node"), F.col("centre").alias("comp")))
    linked = written(compare(groups, nodes, docs, text_col))

    # second turn: across the components of each bucket, among nodes of sizes that allow a link. A size class is a
    # factor of 0.85 wide; a cell holds its own class and the one below it, so such nodes share the larger one's cell
    roots = components(linked)
    size_class = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")
    cells = F.inline(F.array(*[F.struct((size_class + i).alias("cell"), F.lit(not i).alias("own")) for i in (0, 1)]))
    now = members.join(roots.withColumnRenamed("u", "node"), "node", "left").select("value", "band", "node", "n", F.coalesce("root", "node").alias("comp"), cells)
    now = written(now)
    open_ = now.groupBy("value", "cell").agg(
        F.min("comp").alias("one"), F.max("comp").alias("other"), F.count_if("own").alias("own"), F.count("*").alias("_n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    open_ = written(open_.where("one <> other and own > 0").select("value", "cell", "_n", "parts"))
    rest = in_parts(now, ["value", "cell"], open_.drop("_n"), F.col("node"), open_.drop("parts"))
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("mine", "met"), F.greatest("mine", "met")
    g = F.concat_ws(":", *[c.cast("string") for c in (F.col("value"), F.col("cell"), low, high)]).alias("g")
    groups = rest.select(g, "band", F.when(F.col("mine") > F.col("met"), 1).otherwise(0).cast("tinyint").alias("side"), "own", "node", "comp")
    return linked.unionByName(compare(groups, nodes, docs, text_col))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that it is linked with, over any number of
    links, itself included), kept (whether that is its own)."""
    shared_dir(docs.sparkSession)
    every = written(sketches(docs, id_col, text_col))
    nodes = every.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))  # a number each, as written
    roots = components(links(docs, nodes, text_col))
    of = nodes.select("key", "node", "least").join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    thin = every.select("doc_id", "n", "key")
    linked = in_parts(thin.where("key is not null"), ["key"], named, F.monotonically_increasing_id())
    alone = thin.where("key is null").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
