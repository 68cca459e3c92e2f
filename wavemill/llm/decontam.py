"""Benchmark decontamination: a broadcast set of hashed benchmark windows, a scan over every document's
words, and an exact check of what the hashes hit.

A window is 13 consecutive words of an item, or all words of a shorter one. Words are runs of ASCII
letters (in lower case), digits and non-ASCII characters. A document word inside any occurrence of a
window is hit; a document is contaminated if at least one word and 1 in 20 words is hit.

The benchmark's texts are cut into pieces of at most PIECE windows and sized first. Up to BROADCAST_BYTES they
are sent to all tasks at once; a larger benchmark goes in parts of that size, by hash of the pieces. Each part is a
pass of its own over the documents that writes a row for each text with hits: the text's SHA-256, a mask of its hit
words and the items. A part's broadcast is dropped before the next begins, so that no worker or driver ever holds more
than one part. The masks of a text are united at the end and looked up by its SHA-256: they are broadcast if they are
below the same bound, and meet the documents in one shuffle beyond it. Texts are never rewritten between parts.

Cases: null texts and texts without words have no words, no hits and are not contaminated. Items
without words have no windows. An item without an id hits words, but is not counted or named; rows
that repeat an item's id count once. Repeated documents and null ids get one row each. Other columns
are ignored. An empty benchmark hits nothing, an empty document table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, shared_dir, slices, small_batches, written

WINDOW = 13
#: Contaminated from one hit word in so many.
ONE_IN = 20
BROADCAST_BYTES, PIECE = 8 << 20, 4096
#: Every byte that is not in a word becomes a space; letters become lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD_BYTES = np.array([b != 32 for b in FOLD])


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of some items, in arrays: their hashes in order to scan with, word ids to verify with, and the
    items of each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items if item is not None})
        number, at, texts, of_item = {item: i for i, item in enumerate(self.names)}, 0, [], {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(word, len(self.vocabulary) + 1) for word in words(text or b"")]
            if ids:
                size = min(window, len(ids))
                starts = np.arange(at, at + len(ids) - size + 1, dtype=np.int64)
                of_item.setdefault(size, []).append((starts, np.full(len(starts), number.get(item, -1))))
                texts.append(np.array(ids, np.int32))
                at += len(ids)
        self.text = np.concatenate([np.zeros(0, np.int32), *texts])
        self.factors = np.random.default_rng(0).integers(1, 2**63, window, dtype=np.uint64) | np.uint64(1)
        self.sizes = sorted(of_item)
        #: By size: hashes in order, a place where the window's words stand, and its items (from .. to in a list).
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for size in self.sizes:
            start, item = (np.concatenate(x) for x in zip(*of_item[size], strict=True))
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, size)[start]).view(np.dtype((np.void, 4 * size)))[:, 0]
            _, first, of = np.unique(rows, return_index=True, return_inverse=True)
            places = start[first]
            hashes = self.hash(self.text, places, size)
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pairs = np.unique(rank[of] * (len(self.names) + 1) + item + 1)
            window_of, item_of = np.divmod(pairs, len(self.names) + 1)
            named = item_of > 0
            ends = np.searchsorted(window_of[named], np.arange(len(order) + 1)).astype(np.int32)
            self.tables[size] = hashes[order], places[order].astype(np.int32), ends, (item_of[named] - 1).astype(np.int32)

    def hash(self, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(len(at), np.uint64)
        for i in range(size):
            total += ids[at + i].astype(np.uint64) * self.factors[i]
        return total

    def match(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which of the words are hit, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int32, len(found))
        unknown, hit, named = np.r_[0, np.cumsum(ids == 0)], np.zeros(len(ids), bool), set()
        for size in self.sizes:
            if len(ids) < size:
                break
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            hashes, places, ends, items = self.tables[size]
            mine = self.hash(ids, at, size)  # looked up by halving, so that a document costs its own windows only
            row = np.searchsorted(hashes, mine)
            each = np.arange(size)
            while len(at):  # another turn only for windows that share a hash
                some = hashes[np.minimum(row, len(hashes) - 1)] == mine
                some &= row < len(hashes)
                at, row, mine = at[some], row[some], mine[some]
                same = (self.text[places[row][:, None] + each] == ids[at[:, None] + each]).all(axis=1)
                hit[(at[same][:, None] + each).ravel()] = True
                for r in np.unique(row[same]).tolist():
                    named.update(self.names[i] for i in items[ends[r] : ends[r + 1]].tolist())
                at, row, mine = at[~same], row[~same] + 1, mine[~same]
        return hit, named


def unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item, text: the items' texts in pieces that have their windows, and no others; each piece of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = words(text)
                cut = [found[i : i + PIECE + window - 1] for i in range(0, max(1, len(found) - window + 1), PIECE)] if found else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array([b" ".join(x) for x in cut], pa.binary())], names=["item", "text"])

    thin = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    return small_batches(thin).mapInArrow(run, "item string, text binary").distinct()


def parts(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int = BROADCAST_BYTES) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark's windows as broadcasts of bounded size, one at a time, and whether it is the last; one without
    windows if it is empty."""
    shared_dir(benchmark.sparkSession)
    thin = pieces(benchmark, id_col, text_col, window)
    size = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // most) or 1
    if count > 1:
        thin = thin.checkpoint()
    # a part's expected size is below the bound, and a piece's is bounded by its words
    for part in range(count):
        rows = thin.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == part).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Windows([(row.item, bytes(row.text)) for row in rows], window)), part == count - 1


def found(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """For rows of (key, text): key, n_words, bits, items for those that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                hit, named = shared.value.match(words(text))
                if hit.any():
                    rows.append((key, len(hit), np.packbits(hit).tobytes(), sorted(named)))
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names=["key", "n_words", "bits", "items"])

    return texts.mapInArrow(run, "key binary, n_words bigint, bits binary, items array<string>")


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n_words, all_bits (one for each part): key, n_words, n_hit, bits."""
    for batch in batches:
        sizes, all_bits, counts = batch.column(1).to_pylist(), [], []
        for n, masks in zip(sizes, batch.column(2).to_pylist(), strict=True):
            bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in masks])
            all_bits.append(bits.tobytes())
            counts.append(int(np.unpackbits(bits, count=n).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(all_bits, pa.binary())], names=["key", "n_words", "n_hit", "bits"])


def key_of(text_col: str) -> Column:
    return F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))


def masks(docs: DataFrame, text_col: str, passes: Iterator[tuple[Broadcast, bool]]) -> DataFrame:
    """The hits of all parts, a row for each text that has any: key, n_words, n_hit, bits, items."""
    texts = docs.select(key_of(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    tables = []
    for part, (shared, _) in enumerate(passes):
        tables.append(written(found(texts, shared).withColumn("part", F.lit(part))))
        shared.unpersist()
    rows = reduce(DataFrame.union, tables)
    # copies of a text have equal rows: one for each part, whatever the number of copies, before masks meet
    rows = rows.groupBy("key", "n_words", "part").agg(F.first("bits").alias("bits"), F.first("items").alias("items"))
    rows = rows.groupBy("key", "n_words").agg(F.collect_list("bits").alias("all_bits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    bits = small_batches(rows).select("key", "n_words", "all_bits").mapInArrow(united, "key binary, n_words bigint, n_hit bigint, bits binary")
    return written(bits.join(rows.select("key", "items"), "key"))


def below(table: DataFrame, most: int, *columns: str) -> bool:
    """Whether the table's columns (their bytes, and some for each row) are small enough to be broadcast."""
    return (table.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(32)))).first()[0] or 0) <= most


def scan(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the items' ids, sorted as
    strings, comma-joined), contaminated, items (array of their ids)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    thin = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def only_pass(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    hit, named = shared.value.match(words(text))
                    named, n = sorted(named), int(hit.sum())
                    rows.append((len(hit), n, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), n > 0 and one_in * n >= len(hit), named))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds))], names=names)

        return run

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes = [len(words(text)) for text in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64())], names=["doc_id", "key", "n_words"])

    passes = parts(benchmark, item_id_col, item_text_col, window, broadcast_bytes)
    shared, last = next(passes)
    if last:
        return thin.mapInArrow(only_pass(shared), f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>")
    hits = masks(thin, "text", chain([(shared, last)], passes)).select("key", "n_hit", "items")
    rows = thin.withColumn("key", key_of("text")).mapInArrow(counted, f"doc_id {id_type}, key binary, n_words bigint")
    small = below(hits.withColumn("names", F.array_join("items", ",")), broadcast_bytes, "names")
    n, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return looked_up(rows, hits, ["key"], "left", small).select(
        "doc_id", "n_words", n.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n > 0) & (one_in * n >= F.col("n_words"))).alias("contaminated"), items.alias("items"),
    )


def without_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words, and without what stands between two hit words."""
    inside = WORD_BYTES[np.frombuffer(text, np.uint8)]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    out, kept = [], 0
    runs = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    for first, past in runs.reshape(-1, 2).tolist():
        out.append(text[kept : starts[first]])
        kept = ends[past - 1]
    return b"".join([*out, text[kept:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The documents, all columns, without the contaminated ones (remove="documents"), or all of them
    with the hit spans cut out of the text (remove="spans"). Null texts stay null. In a benchmark of
    several parts, both go by the hits of all parts together."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    at = small_batches(docs).columns.index(text_col)
    hits = "hits"
    while hits in docs.columns:
        hits += "_"

    def mark(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                bits = []
                for text in part.column(at).cast(pa.binary()).to_pylist():
                    bits.append(np.packbits(shared.value.match(words(text or b""))[0]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(bits, pa.binary())], names=part.schema.names)

        return run

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            mask = []
            for text, bits in zip(part.column(at).cast(pa.binary()).to_pylist(), part.columns[-1].to_pylist(), strict=True):
                n = int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum())
                mask.append(not n or one_in * n < len(words(text or b"")))
            yield part.filter(pa.array(mask, pa.bool_()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = part.column(at).cast(pa.binary()).to_pylist()
            for i, (text, bits) in enumerate(zip(texts, part.columns[-1].to_pylist(), strict=True)):
                if text and bits and any(bits):
                    texts[i] = without_spans(text, unpacked(bits, len(words(text))))
            columns = list(part.columns)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    passes = parts(benchmark, item_id_col, item_text_col, window, broadcast_bytes)
    shared, last = next(passes)
    if last:
        docs = docs.withColumn(hits, F.lit(None).cast("binary"))
        return docs.mapInArrow(mark(shared), docs.schema).mapInArrow(cut if remove == "spans" else keep, docs.schema).drop(hits)
    columns, united_hits = docs.columns, masks(docs, text_col, chain([(shared, last)], passes))
    key = "key"
    while key in columns:
        key += "_"
    docs = docs.withColumn(key, key_of(text_col))
    if remove == "documents":
        bad = united_hits.where(F.col("n_hit") * one_in >= F.col("n_words")).select(F.col("key").alias(key))
        return looked_up(docs, bad, [key], "left_anti", below(bad, broadcast_bytes)).select(columns)
    docs = looked_up(docs, united_hits.select(F.col("key").alias(key), F.col("bits").alias(hits)), [key], "left", below(united_hits, broadcast_bytes, "bits")).select(*columns, hits)
    return docs.mapInArrow(cut, docs.schema).drop(hits)


SQL = r"""
WITH items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
    FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
    SELECT row, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
    FROM texts, (SELECT DISTINCT size FROM windows) s, unnest(range(1, len(w) - size + 2)) AS t(i)
), found AS (
    SELECT DISTINCT row, i, size, item_id FROM grams JOIN windows USING (size, gram)
), hit AS (
    SELECT row, count(DISTINCT p) AS n FROM found, unnest(range(i, i + size)) AS t(p) GROUP BY row
), named AS (
    SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM texts LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""
