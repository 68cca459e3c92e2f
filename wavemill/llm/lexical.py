"""Ranked lexical search: the documents of the highest term-weighted scores for each item of a set of queries.

The items' words are numbered and broadcast, in parts of at most BROADCAST_BYTES of their text; a part is a pass of
its own over the documents. A pass counts every document's terms and the items' words in it, whole texts read, and writes these
postings as a compressed table. Document counts and lengths, and how many documents hold each word, come from that
table by grouped sums. Then each task reads its postings in shards of about SHARD postings, orders a shard's documents by
id, and lays a posting list for each word with a sparse table over it: the greatest impact of every span of two to
the power of i postings, so that the greatest one within any document interval is two look-ups. An item's search begins
with the interval of all documents. Its bound is the sum of each word's weight times its greatest impact there. The
interval of the highest bound is opened next: it is split at the document where the word of the greatest part of
the bound has its maximum; that document is scored, and what lies to its left and right gets bounds of its own. A search
ends when no bound can enter the item's best k. Intervals of LEAF postings or fewer are scored whole, and so is what
is left once as many splits were made as such scans would have taken, so a search costs twice a full scan at most. The
best k of a task's earlier shards are the floor for its next. A task yields k rows an item at most, which are merged by item.

Postings lists are cut by documents, so a word that most documents hold is spread like any other rows.

Cases: null texts have no terms. Every row is a document of its own; rows without an id count and are ranked, behind
the ids of equal score. Items that repeat id and text count once; items of one id with other texts are items of their own
(k rows each). Items without terms, and words that no document holds, find nothing. Other columns are ignored. Empty
tables give empty results. Scores below 2^53 are exact.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, slices, small_batches, written

K = 10
#: Tenths of the usual k1, and hundredths of the usual b.
K1, B = 8, 75
BROADCAST_BYTES = 8 << 20
SHARD, LEAF = 1 << 18, 1024
#: Bytes of a text whose words are listed at a time.
PIECE = 1 << 20
#: Every byte that is not in a term becomes a space; letters become lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part of it at a time."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        yield text[at : end if end >= 0 else len(text)].split()
        at = end if end >= 0 else len(text)


class Items:
    """The words of some items, numbered, and each item's words with how often they occur."""

    def __init__(self, rows: list[tuple[object, bytes]]):
        self.number: dict[bytes, int] = {}
        self.ids, self.words, self.times = [], [], []
        for item, text in rows:
            counted = Counter(w for part in terms(text) for w in part)
            if counted:
                self.ids.append(item)
                self.words.append(np.array([self.number.setdefault(w, len(self.number)) for w in counted], np.int64))
                self.times.append(np.array(list(counted.values()), np.int64))

    def count(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Terms of a text, the items' words among them and how often they occur."""
        n, have, get = 0, [], self.number.get
        for part in terms(text):
            n += len(part)
            mine = np.array([i for i in map(get, part) if i is not None], np.int64)
            if len(mine):
                have.append(np.unique(mine, return_counts=True))
        if len(have) < 2:
            return (n, *(have[0] if have else (np.zeros(0, np.int64),) * 2))
        words, of = np.unique(np.concatenate([w for w, _ in have]), return_inverse=True)
        return n, words, np.bincount(of, weights=np.concatenate([c for _, c in have])).astype(np.int64)


class Shard:
    """Posting lists of some documents, in order of their ids, with sparse tables of their greatest impacts."""

    def __init__(self, ids: list[int | None], words: np.ndarray, at: np.ndarray, impact: np.ndarray, vocabulary: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [(ids[i] is None, ids[i] or 0) for i in order]
        self.n = len(ids)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        at = place[at]
        by = np.lexsort((at, words))
        words, self.at, self.impact = words[by], at[by], impact[by]
        self.keys = words * self.n + self.at
        self.ends = np.searchsorted(words, np.arange(vocabulary + 1))
        # equal impacts are told apart at random, so that splits fall anywhere among them
        self.tie = np.random.default_rng(self.n).permutation(self.n)
        self.untie = np.argsort(self.tie)
        tops = [self.impact << 32 | self.tie[self.at]]
        longest = int(np.diff(self.ends).max(initial=1))
        for level in range(1, longest.bit_length()):
            half, last = 1 << (level - 1), tops[-1]
            tops.append(np.concatenate([np.maximum(last[:-half], last[half:]), last[-half:]]))
        self.tops = np.array(tops)

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The greatest impact of postings a to b, above the tie number of its document."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.maximum(self.tops[level, a], self.tops[level, b - (1 << level)])

    def search(self, words: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, tuple[bool, int]]]) -> None:
        """Puts what belongs to the k best, as (-score, id), into the list in order."""

        def offer(score: int, doc: int) -> None:
            if score > 0 and (len(best) < k or (-score, self.ids[doc]) < best[-1]):
                insort(best, (-score, self.ids[doc]))
                del best[k:]

        def add(lo: int, hi: int, words: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            some = b > a
            if not some.all():
                words, weights, a, b = words[some], weights[some], a[some], b[some]
            if len(a):
                tops = self.greatest(a, b)
                parts = weights * (tops >> 32)
                bound = int(parts.sum())
                if bound > 0 and (len(best) < k or (-bound, self.ids[lo]) < best[-1]):
                    heapq.heappush(heap, (-bound, lo, hi, words, weights, a, b, int(tops[parts.argmax()] & 0xFFFFFFFF)))

        heap: list[tuple] = []
        a, b = self.ends[words], self.ends[words + 1]
        splits = int((b - a).sum()) // LEAF + 8
        add(0, self.n, words, weights, a, b)
        while heap:
            bound, lo, hi, words, weights, a, b, tie = heapq.heappop(heap)
            if len(best) == k and (bound, self.ids[lo]) >= best[-1]:
                if bound > best[-1][0]:
                    return  # all others are lower still
                continue
            size = b - a
            if splits <= 0 or size.sum() <= LEAF:
                spots = np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)
                scores = np.bincount(self.at[spots] - lo, weights=np.repeat(weights, size) * self.impact[spots]).astype(np.int64)
                top = np.flatnonzero(scores >= (-best[-1][0] if len(best) == k else 1))
                for doc in top[np.argsort(-scores[top], kind="stable")[:k]].tolist():
                    offer(int(scores[doc]), lo + doc)
                continue
            splits -= 1
            doc = int(self.untie[tie])
            cut = np.clip(np.searchsorted(self.keys, words * self.n + doc), a, b)
            hit = (cut < b) & (self.at[np.minimum(cut, len(self.at) - 1)] == doc)
            offer(int((weights[hit] * self.impact[cut[hit]]).sum()), doc)
            add(lo, doc, words, weights, a, cut)
            if doc + 1 < hi:
                add(doc + 1, hi, words, weights, cut + hit, b)


def parts(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Broadcast]:
    """The items as broadcasts of about that many bytes of text, one at a time."""
    thin = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("text is not null").distinct()
    size = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // most)
    if count > 1:
        thin = written(thin)
    for part in range(count):
        rows = thin.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == part).collect()  # bounded by most, or one item
        yield items.sparkSession.sparkContext.broadcast(Items([(r.item_id, bytes(r.text)) for r in rows]))


def postings(docs: DataFrame, shared: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms), words and times (of the items' words, packed) of every document."""
    thin = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for part in slices(batches):
            n, words, times = zip(*(items.count(text) for text in part.column(1).cast(pa.binary()).to_pylist()), strict=True)
            packed = [pa.array([x.astype("<i4").tobytes() for x in column], pa.binary()) for column in (words, times)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *packed], names=["doc_id", "n", "words", "times"])

    return written(thin.mapInArrow(run, "doc_id long, n long, words binary, times binary"))


def numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


def holding(table: DataFrame, shared: Broadcast) -> np.ndarray:
    """How many documents hold each word: a sum of the tasks' counts."""
    size = len(shared.value.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(numbers(batch.column(0)), minlength=size)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], names=["word", "n"])

    out = np.zeros(size, np.int64)
    for row in table.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # the part's words
        out[row.word] = row.n
    return out


def rank(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES, shard: int = SHARD,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0."""
    id_type = items.schema[item_id_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for shared in parts(items, item_id_col, item_text_col, broadcast_bytes):
        if shared.value.ids:
            found = search(postings(docs, shared, id_col, text_col), shared, k, id_type, shard)
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            out = out.union(written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")))
        shared.unpersist()
    return out


def search(table: DataFrame, shared: Broadcast, k: int, id_type: str, shard: int) -> DataFrame:
    """item (its number), item_id, doc_id, score: each task's k best documents of each item."""
    n_docs, length = table.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = holding(table, shared)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    weighed = table.sparkSession.sparkContext.broadcast(weights)
    schema = table.select(F.lit(0).alias("item"), F.lit(None).cast(id_type).alias("item_id"), "doc_id", F.lit(0).cast("long").alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        items, weights = shared.value, weighed.value
        best: list[list] = [[] for _ in items.ids]

        def visit(ids: list, n: list[int], words: list[bytes], times: list[bytes]) -> None:
            sizes = np.array([len(x) // 4 for x in words])
            word, tf = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (words, times))
            m = np.array([100 - B + B * x * n_docs // length for x in n], np.int64)  # of any size before they are divided
            at = np.repeat(np.arange(len(ids)), sizes)
            index = Shard(ids, word, at, 1_000_000_000 * tf // (1000 * tf + K1 * m[at]), len(weights))
            for mine, w, q in zip(best, items.words, items.times, strict=True):
                index.search(w, weights[w] * q, k, mine)

        held, size = ([], [], [], []), 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "words", "times")), strict=True):
                if row[2]:
                    for column, value in zip(held, row, strict=True):
                        column.append(value)
                    size += len(row[2]) // 4
                if size >= shard:
                    visit(*held)
                    held, size = ([], [], [], []), 0
        if size:
            visit(*held)
        rows = [(i, item, None if null else doc, -score) for i, (item, mine) in enumerate(zip(items.ids, best, strict=True)) for score, (null, doc) in mine]
        kinds = pa.schema([("item", pa.int32()), ("item_id", id_kind(id_type)), ("doc_id", pa.int64()), ("score", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.types)], schema=kinds)

    return small_batches(table).mapInArrow(run, schema)


def id_kind(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[name]


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, word, count(*) AS q FROM (SELECT i, item_id, unnest(words) AS word FROM items) GROUP BY ALL),
total AS (SELECT count(*) AS n, CAST(sum(len(words)) AS BIGINT) AS l FROM docs WHERE len(words) > 0),
posted AS (SELECT r, doc_id, size, word, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS size, unnest(words) AS word FROM docs) WHERE word IN (SELECT word FROM asked) GROUP BY ALL),
weights AS (SELECT word, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posted, total GROUP BY word, n),
scored AS (SELECT i, item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + {K1} * ({100 - B} + ({B} * size * n) // l)))) AS BIGINT) AS score FROM asked JOIN posted USING (word) JOIN weights USING (word), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {K}
"""
