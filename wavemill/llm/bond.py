"""Hard negatives by a vertical scan with branch and bound over the dimensions.

Vectors become integer points and are dealt by hash into blocks of about BLOCK points, laid out by dimension. An anchor
reads a block's dimensions in the order of its own components' magnitudes, STEP at a time, and keeps a bitmap of the
points that are still candidates, each with its score so far. What the dimensions that are left can add at least and at
most follows from the block's least and greatest values of each. Two scans use these bounds:

* positives: of the points with the anchor's label, those go that cannot reach the k-th best of the lower bounds;
* negatives: of the points with other labels, those go that no positive's window of scores can hold any more, and those
  below the last place of a window that surely holds enough better ones.

At the last dimension the scores of what is left are exact. The positives of all blocks are merged before the
negatives' windows are known. Chunks of CHUNK anchors meet blocks, a packed row each, so a task holds one of either; every anchor
is to be held against every row, so the number of meetings grows with anchors times rows. A meeting yields k rows a window at
most. Nothing is broadcast, and no block depends on labels, so a frequent label or a repeated vector makes no hot task.

Cases: rows with a null id, label or vector, an empty vector, null or non-finite components, or another length than the most common
one take no part. Rows that repeat id, label and vector count once; rows of one id with other vectors or labels are points (and
anchors) of their own, but never match a row of their own id. Ties go to the smaller id. Fewer rows than asked for: all. An
anchor without positives, and a positive whose window is empty (a negative score's always is), yields no row. Labels are
integers. Empty tables give empty results; other columns are ignored. Scores below 2^46 are exact.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, small_batches, written
from .topk import matrix, packed, points

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Hundredths of a positive's score that a negative's has at least and at most.
LOW, HIGH = 50, 95
#: Points of a block, anchors of a chunk, dimensions read between two looks at the bounds.
BLOCK, CHUNK, STEP = 8192, 1024, 8


class Vertical:
    """A block's points by dimension, in the order of their labels, with each dimension's range."""

    def __init__(self, raw: bytes, size: int, ids: np.ndarray, labels: np.ndarray):
        self.columns = np.frombuffer(raw, "<i2" if raw[:1] == b"s" else "<i8", offset=1).reshape(size, -1).astype(np.float64)
        self.ids, self.labels = ids, labels
        self.least, self.greatest = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, q: np.ndarray, alive: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """The places that shrink(lower, upper), asked after every STEP dimensions, leaves over, and their scores."""
        order = np.argsort(-abs(q), kind="stable")
        ends = np.stack([q * self.least, q * self.greatest])[:, order]
        most, least = (np.r_[x[::-1].cumsum()[::-1], 0.0] for x in (ends.max(axis=0), ends.min(axis=0)))
        scores = np.zeros(len(alive))
        for a in range(0, len(q), STEP):
            dims = order[a : a + STEP]
            scores += q[dims] @ (self.columns[dims] if len(alive) == self.columns.shape[1] else self.columns[dims[:, None], alive])
            done = min(a + STEP, len(q))
            keep = shrink(scores + least[done], scores + most[done])
            if not keep.all():
                alive, scores = alive[keep], scores[keep]
            if not len(alive):
                break
        return alive, scores

    def positives(self, q: np.ndarray, of: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best points of the label."""
        alive = np.arange(*np.searchsorted(self.labels, [label, label + 1]))
        alive = alive[self.ids[alive] != of]

        def shrink(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            return upper >= np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else np.ones(len(lower), bool)

        alive, scores = self.scan(q, alive, shrink)
        top = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[top]], scores[top]

    def negatives(self, q: np.ndarray, of: int, label: int, goals: np.ndarray, k: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best points of other labels in each goal's window."""
        alive = np.flatnonzero((self.labels != label) & (self.ids != of))
        floor, roof = low * goals[:, None], high * goals[:, None]

        def shrink(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            open_ = (100 * upper >= floor) & (100 * lower <= roof)
            sure = (100 * lower >= floor) & (100 * upper <= roof)
            for i in np.flatnonzero(sure.sum(axis=1) >= k):
                some = lower[sure[i]]
                open_[i] &= upper >= np.partition(some, len(some) - k)[len(some) - k]
            return open_.any(axis=0)

        alive, scores = self.scan(q, alive, shrink)
        out = []
        for a, b in zip(floor[:, 0], roof[:, 0], strict=True):
            inside = np.flatnonzero((100 * scores >= a) & (100 * scores <= b))
            top = inside[np.lexsort((self.ids[alive[inside]], -scores[inside]))[:k]]
            out.append((self.ids[alive[top]], scores[top]))
        return out


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor and each of its
    best rows of the same label, the best rows of other labels that score low to high hundredths of it."""
    spark = rows.sparkSession
    shared_dir(spark)
    rows = rows.where(F.col(label_col).isNotNull())
    every = points(rows, id_col, vector_col, scale, F.col(label_col).cast("long").alias("label"))
    every = written(small_batches(every).distinct().withColumn("h", F.xxhash64("vec_id", "label", "p")).withColumn("asks", F.coalesce(is_anchor, F.lit(False))))
    sizes = every.groupBy(F.size("p").alias("size")).agg(F.count("*").alias("n"), F.count_if("asks").alias("anchors")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes or not sizes[0].anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    size, n_blocks, n_chunks = sizes[0]["size"], ceil(sizes[0].n / block), ceil(sizes[0].anchors / chunk)
    every = every.where(F.size("p") == size)
    anchors = every.where("asks").withColumn("chunk", F.pmod("h", F.lit(n_chunks)).cast("int")).select("chunk", "vec_id", "label", "h", "p")

    def by_dimension(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        parts = [table["vec_id"].to_numpy().tobytes(), table["label"].to_numpy().tobytes(), packed(np.ascontiguousarray(matrix(table["p"], size).T))]
        return pa.table([pa.array([table["block"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], names=["block", "ids", "labels", "columns"])

    dealt = every.select(F.pmod("h", F.lit(n_blocks)).cast("int").alias("block"), "vec_id", "label", "p")
    blocks = written(dealt.groupBy("block").applyInArrow(by_dimension, "block int, ids binary, labels binary, columns binary"))
    blocks = blocks.withColumn("of_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))

    def packs(table: pa.Table) -> pa.Table:
        parts = [table[c].to_numpy().tobytes() for c in ("vec_id", "label", "h")] + [np.ascontiguousarray(matrix(table["p"], size)).astype("<i8").tobytes()]
        goals = table["goals"].to_pylist()
        return pa.table([pa.array([table["chunk"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in parts), pa.array([goals], pa.list_(pa.list_(pa.int64())))], names=["chunk", "ids", "labels", "h", "p", "goals"])

    def meet(anchors: DataFrame, each, schema: str) -> DataFrame:
        """What each(block, anchor's vector, id, label, goals) yields for all anchors and blocks, after the anchor's id and h."""
        chunks = written(anchors.groupBy("chunk").applyInArrow(packs, "chunk int, ids binary, labels binary, h binary, p binary, goals array<array<long>>"))
        chunks = chunks.withColumn("to_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        names = [c.split()[0] for c in schema.split(", ")]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros((len(names), 0), np.int64)]
            if left.num_rows and right.num_rows:
                a, b = left.to_pylist()[0], right.to_pylist()[0]
                there = Vertical(b["columns"], size, np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64))
                ids, labels, h = (np.frombuffer(a[c], np.int64) for c in ("ids", "labels", "h"))
                for q, of, label, key, goals in zip(np.frombuffer(a["p"], "<i8").reshape(-1, size).astype(np.float64), ids.tolist(), labels.tolist(), h.tolist(), a["goals"], strict=True):
                    found = each(there, q, of, label, np.array(goals, np.float64))
                    out.append(np.concatenate([np.full((1, found.shape[1]), of), np.full((1, found.shape[1]), key), found.astype(np.int64)]))
            return pa.table(list(map(pa.array, np.concatenate(out, axis=1))), names=names)

        return chunks.groupBy("to_block", "chunk").cogroup(blocks.groupBy("block", "of_chunk")).applyInArrow(run, schema)

    none = F.array().cast("array<long>").alias("goals")
    near = meet(anchors.withColumn("goals", none), lambda there, q, of, label, _: np.stack(there.positives(q, of, label, positives)), "anchor_id long, h long, positive_id long, score long")
    best = Window.partitionBy("anchor_id", "h").orderBy(F.desc("score"), "positive_id")
    chosen = written(near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives))
    goals = chosen.groupBy("anchor_id", "h").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("goals"))
    asking = anchors.join(goals.select(F.col("anchor_id").alias("vec_id"), "h", F.col("goals.score").alias("goals")), ["vec_id", "h"])

    def far(there: Vertical, q: np.ndarray, of: int, label: int, goals: np.ndarray) -> np.ndarray:
        found = there.negatives(q, of, label, goals, negatives, low, high)
        return np.concatenate([np.stack([np.full(len(ids), i + 1), ids, scores]) for i, (ids, scores) in enumerate(found)], axis=1)

    hard = meet(asking, far, "anchor_id long, h long, nth long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "h", "nth").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = chosen.select("anchor_id", "h", F.col("nth").cast("long").alias("nth"), "positive_id", F.col("score").alias("positive_score"))
    return hard.join(named, ["anchor_id", "h", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def sql(every: int = 50, label: str = "label") -> str:
    """The same for vectors of one length without repeated ids."""
    return f"""
WITH points AS (
    SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.p AS DOUBLE[]), CAST(b.p AS DOUBLE[])) AS BIGINT) AS score
    FROM points a JOIN points b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
