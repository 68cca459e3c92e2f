"""Exact top-k by inner product with dual-tree search over cover trees.

Vectors become integer points; queries are points of the same index as the data. A cover tree over a bounded
sample (SAMPLE points, by hash; it steers the speed only) has a leaf for about every BLOCK points: its
levels are nets of halving radius, each point of a level covered by one of the level above and farther from
the others of its own level than the radius. Every point goes to the cell of its nearest leaf, and a cell is
cut by hash into blocks of bounded size. The cells' largest distances give every node of the tree a covering
radius. A block's queries, in groups, meet their own block first, which gives every query a kth score to
beat. A group then walks down the tree: a node is left out if the best score that the two covering balls
allow is below the group's worst kth score. Only the pairs of groups and blocks that are left meet. There,
both sides are cover trees again, and node pairs are visited best bound first and left out by the covering
radii against the query node's worst kth score, which rises on the way. Leaf pairs are exact integer products.

Blocks and groups travel as one row each, of bounded size. A block is shipped once for every GROUPS_AT_ONCE
groups, not once per group. Broadcast are the tree of the sample and a count and radius for each cell, CENTRES
at most; nothing that grows with the rows is broadcast or collected. Each meeting yields k rows a query at most,
merged by query.

Cases: vectors that are null or empty, hold null or non-finite components, have another length than
the most common one, or have a null id take no part. Rows that repeat id and vector count once; rows of
one id with other vectors are points of their own, and queries of their own (k rows each). A query
never matches rows of its own id. Ties go to the smaller id. Fewer candidates than k: all. Empty tables
give empty results; other columns are ignored. Scores below 2^53 are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, small_batches

SCALE, K = 64, 20
#: Points of a block, queries of a group, leaves of the sample's tree at most, and points of the sample.
BLOCK, GROUP, CENTRES, SAMPLE = 8192, 1024, 16_384, 16_384
#: Groups that a block meets in one task.
GROUPS_AT_ONCE = 64
LEAF, QUERY_LEAF = 256, 128


def net(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Farthest points first: the places of at most so many centres, how far each was from those before it, and each
    point's nearest centre. Every prefix is a net: what is left is no farther from it than its members are apart."""
    lengths = (points**2).sum(axis=1)

    def away(i: int) -> np.ndarray:
        return np.maximum(lengths - 2 * (points @ points[i]) + lengths[i], 0)

    picked, apart, who = [0], [np.inf], np.zeros(len(points), np.int64)
    near = away(0)
    while len(picked) < most and near.max() > 0:
        i = int(near.argmax())
        apart.append(float(np.sqrt(near[i])))
        d = away(i)
        closer = d < near
        near[closer], who[closer] = d[closer], len(picked)
        picked.append(i)
    return np.array(picked), np.array(apart), who


class CoverTree:
    """Nodes in arrays. Level i is a net of radius apart[1] / 2^i: its centres are farther apart than that, and
    every centre of a lower level is within it of a centre of this level, its parent or its parent's parent and so
    on. A centre stays a centre in the levels below. Where a level adds nothing to a node, the node goes on."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.points = points.astype(np.float64)
        self.picked, self.apart, self.who = net(self.points, leaves)
        centres = self.points[self.picked]
        self.centre, self.level, self.children, self.leaf = [centres[0]], [0], [[]], {}
        at = [0]  # the node of each centre so far
        level = 0
        while len(at) < len(self.picked):
            level += 1
            have, more = len(at), int((self.apart > self.apart[1] / 2**level).sum())
            fresh = centres[have:more]
            d = (fresh**2).sum(axis=1)[:, None] - 2 * fresh @ centres[:have].T + (centres[:have] ** 2).sum(axis=1)
            parents = d.argmin(axis=1) if len(fresh) else []
            for parent in set(map(int, parents)):
                at[parent] = self.add(at[parent], centres[parent], level)
            # the parent's node of the level above is the one that its own new node hangs from
            for j, parent in enumerate(map(int, parents)):
                at.append(self.add(self.above[at[parent]], centres[have + j], level))
        self.leaf = {node: cell for cell, node in enumerate(at)}

    above: dict[int, int]

    def add(self, parent: int, centre: np.ndarray, level: int) -> int:
        node = len(self.centre)
        self.centre.append(centre), self.level.append(level), self.children.append([])
        self.children[parent].append(node)
        self.__dict__.setdefault("above", {})[node] = parent
        return node

    def cover(self, reach: np.ndarray) -> CoverTree:
        """Gives each node its covering radius: the distances of the leaves below it plus their own reach."""
        leaves: list[list[int]] = [[self.leaf[i]] if i in self.leaf else [] for i in range(len(self.centre))]
        for node in range(len(self.centre) - 1, 0, -1):
            leaves[self.above[node]] += leaves[node]
        centres = self.points[self.picked]
        self.radius = [float((np.sqrt(((centres[some] - c) ** 2).sum(axis=1)) + reach[some]).max()) + 1e-9 for some, c in zip(leaves, self.centre, strict=True)]
        return self

    def hold(self) -> CoverTree:
        """Puts the points in order, so that each node's stand together (first to past), with exact covering radii."""
        n = len(self.centre)
        self.first, self.past, self.radius = [0] * n, [0] * n, [0.0] * n
        by, ends = np.argsort(self.who, kind="stable"), np.cumsum(np.bincount(self.who, minlength=len(self.picked)))
        order, todo = [], [(0, False)]
        at = 0
        while todo:
            node, done = todo.pop()
            if not done:
                self.first[node] = at
                if node in self.leaf:
                    cell = self.leaf[node]
                    mine = by[(ends[cell - 1] if cell else 0) : ends[cell]]
                    order.append(mine)
                    at += len(mine)
                todo += [(node, True), *((child, False) for child in self.children[node])]
            else:
                self.past[node] = at
        self.order = np.concatenate(order)
        self.sorted = self.points[self.order]
        for node in range(n):
            mine = self.sorted[self.first[node] : self.past[node]] - self.centre[node]
            self.radius[node] = float(np.sqrt((mine**2).sum(axis=1).max(initial=0.0))) + 1e-9
        return self


def best(qc: np.ndarray, qr: float, rc: np.ndarray, rr: float) -> float:
    """No inner product of points in the two balls is larger; the last term is for rounding."""
    q, r = np.sqrt(qc @ qc), np.sqrt(rc @ rc)
    return float(qc @ rc + q * rr + r * qr + qr * rr + 1e-9 * (1 + (q + qr) * (r + rr)))


def holding(points: np.ndarray, leaf: int) -> CoverTree:
    return CoverTree(points, ceil(len(points) / leaf)).hold()


def dual_tree(queries: np.ndarray, qid: np.ndarray, data: np.ndarray | CoverTree, did: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query, the k best points that reach its floor: query's place, data id, score."""
    n = len(queries)
    if not n or not len(did):
        return (np.zeros(0, np.int64),) * 3
    qt, rt = holding(queries, QUERY_LEAF), data if isinstance(data, CoverTree) else holding(data, LEAF)
    scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    q, r = qt.sorted, rt.sorted
    qids, rids = qid[qt.order], did[rt.order]
    floors = floor[qt.order].astype(np.float64)
    kth = floors.copy()
    heap = [(-best(qt.centre[0], qt.radius[0], rt.centre[0], rt.radius[0]), 0, 0)]
    while heap:
        bound, x, y = heapq.heappop(heap)
        a, b, c, d = qt.first[x], qt.past[x], rt.first[y], rt.past[y]
        # strictly below the worst kth score of the node's queries: equal scores may win by their id
        if -bound < kth[a:b].min():
            continue
        xs, ys = qt.children[x], rt.children[y]
        if not xs and not ys:
            found = q[a:b] @ r[c:d].T
            found[qids[a:b, None] == rids[None, c:d]] = -np.inf
            hit = np.flatnonzero((found >= kth[a:b, None]).any(axis=1))
            if len(hit):
                found, rows = found[hit], hit + a
                found[found < kth[rows, None]] = -np.inf
                all_s = np.concatenate([scores[rows], found], axis=1)
                all_i = np.concatenate([ids[rows], np.broadcast_to(rids[c:d], found.shape)], axis=1)
                top = np.lexsort((all_i, -all_s))[:, :k]
                scores[rows], ids[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
                kth[rows] = np.maximum(floors[rows], scores[rows, k - 1])
            continue
        # the larger ball is opened
        if ys and (not xs or rt.radius[y] >= qt.radius[x]):
            pairs = [(x, child) for child in ys]
        else:
            pairs = [(child, y) for child in xs]
        for u, v in pairs:
            new = best(qt.centre[u], qt.radius[u], rt.centre[v], rt.radius[v])
            if new >= kth[qt.first[u] : qt.past[u]].min():
                heapq.heappush(heap, (-new, u, v))
    at, place = np.nonzero(scores > -np.inf)
    return qt.order[at], ids[at, place], scores[at, place]


def points(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, *more: Column) -> DataFrame:
    """vec_id, p, the integer components floor(scale * x), and more columns of the rows that take part."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    return rows.where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("p"), *more)


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(-1, size)


def packed(p: np.ndarray) -> bytes:
    small = len(p) and abs(p).max() < 1 << 15
    return (b"s" if small else b"l") + p.astype("<i2" if small else "<i8").tobytes()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"s" else "<i8", offset=1).reshape(-1, size).astype(np.float64)


PACKED = "cell int, part long, nth int, ids binary, h binary, p binary, floor binary, found array<struct<query_id:bigint,h:bigint,vec_id:bigint,score:bigint>>"
FOUND = pa.struct([("query_id", pa.int64()), ("h", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(
    rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
    block: int = BLOCK, group: int = GROUP, centres: int = CENTRES, sample: int = SAMPLE, groups_at_once: int = GROUPS_AT_ONCE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores over all rows but its own."""
    spark = rows.sparkSession
    shared_dir(spark)
    all_points = small_batches(points(rows, id_col, vector_col, scale)).distinct().withColumn("h", F.xxhash64("vec_id", "p")).checkpoint()
    sizes = all_points.groupBy(F.size("p").alias("size")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes or not sizes[0].q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, n_points = sizes[0]["size"], sizes[0].n
    all_points = all_points.where(F.size("p") == size)
    drawn = all_points.orderBy("h", "vec_id").limit(sample).select("p").toArrow()  # bounded by sample
    top = CoverTree(matrix(drawn["p"], size), min(centres, ceil(n_points / block)))
    seeds = spark.sparkContext.broadcast(top.points[top.picked])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a in range(0, part.num_rows, 1024):
                some = part.slice(a, 1024)
                p, c = matrix(some.column("p"), size).astype(np.float64), seeds.value
                d = (c**2).sum(axis=1) - 2 * p @ c.T
                cell = d.argmin(axis=1)
                away = np.sqrt(np.maximum(d[np.arange(len(p)), cell] + (p**2).sum(axis=1), 0)) + 1e-9
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[*some.schema.names, "cell", "away"])

    indexed = all_points.select("vec_id", "p", "h", is_query.alias("asks")).mapInArrow(cells, "vec_id long, p array<bigint>, h long, asks boolean, cell int, away double").checkpoint()
    per_cell = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.count_if("asks").alias("q")).collect()  # a row a centre
    parts, reach = np.zeros(len(top.picked), np.int64), np.zeros(len(top.picked))
    for c in per_cell:
        parts[c.cell], reach[c.cell] = ceil(c.n / block), c.away
    n_groups = sum(int(parts[c.cell]) + ceil(c.q / group) for c in per_cell)  # at most
    chunks = max(1, ceil(n_groups / groups_at_once))
    shared = spark.sparkContext.broadcast((top.cover(reach), parts))

    def pack(table: pa.Table) -> pa.Table:
        """A block as one row, and a row for each group of its queries with what they find in the block."""
        p, ids, h, asks = matrix(table["p"], size), table["vec_id"].to_numpy(), table["h"].to_numpy(), table["asks"].to_numpy().astype(bool)
        cell, part = table["cell"][0].as_py(), table["part"][0].as_py()
        out = [(cell, part, -1, ids.tobytes(), b"", packed(p), b"", [])]
        asking = np.flatnonzero(asks)
        tree = holding(p, LEAF) if len(asking) else None
        for nth, a in enumerate(range(0, len(asking), group)):
            mine = asking[a : a + group]
            at, found_ids, scores = dual_tree(p[mine].astype(np.float64), ids[mine], tree, ids, k, np.full(len(mine), -np.inf))
            full = np.bincount(at, minlength=len(mine)) == k
            floor = np.full(len(mine), np.inf)
            np.minimum.at(floor, at, scores)
            floor[~full] = -np.inf
            found = [dict(zip(FOUND.names, row, strict=True)) for row in zip(ids[mine][at].tolist(), h[mine][at].tolist(), found_ids.tolist(), scores.astype(np.int64).tolist(), strict=True)]
            out.append((cell, part, nth, ids[mine].tobytes(), h[mine].tobytes(), packed(p[mine]), floor.tobytes(), found))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(FOUND)]
        return pa.table([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in PACKED.split(", ")])

    cut = F.broadcast(spark.createDataFrame([(c, int(n)) for c, n in enumerate(parts)], "cell int, parts long"))  # a row a centre
    packs = indexed.join(cut, "cell").withColumn("part", F.pmod("h", "parts")).select("cell", "part", "vec_id", "p", "h", "asks").groupBy("cell", "part").applyInArrow(pack, PACKED).checkpoint()
    blocks, groups = packs.where("nth < 0"), packs.where("nth >= 0")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that each group cannot leave out."""
        tree, parts = shared.value
        for batch in batches:
            for cell, part, nth, raw, floor in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "nth", "p", "floor")), strict=True):
                q, worst = unpacked(raw, size), np.frombuffer(floor).min()
                centre = q.mean(axis=0)
                radius = float(np.sqrt(((q - centre) ** 2).sum(axis=1).max())) + 1e-9
                left, todo = [], [0]
                while todo:
                    node = todo.pop()
                    if best(centre, radius, tree.centre[node], tree.radius[node]) < worst:
                        continue
                    todo += tree.children[node]
                    if (leaf := tree.leaf.get(node)) is not None:
                        left += [(leaf, i) for i in range(parts[leaf]) if (leaf, i) != (cell, part)]
                for a in range(0, len(left), 1 << 16):
                    some = left[a : a + (1 << 16)]
                    columns = [[cell] * len(some), [part] * len(some), [nth] * len(some), *zip(*some, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cell", "part", "nth", "to_cell", "to_part"])

    pairs = groups.select("cell", "part", "nth", "p", "floor").mapInArrow(walk, "cell int, part long, nth int, to_cell int, to_part long")
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("cell", "part", "nth"), F.lit(chunks))).checkpoint()
    asked = pairs.join(groups.select("cell", "part", "nth", "ids", "h", "p", "floor"), ["cell", "part", "nth"]).select("to_cell", "to_part", "chunk", "ids", "h", "p", "floor")
    met = pairs.select(F.col("to_cell").alias("cell"), F.col("to_part").alias("part"), F.col("chunk").alias("of_chunk")).distinct().join(blocks.select("cell", "part", "ids", "p"), ["cell", "part"])
    met = met.withColumnsRenamed({"cell": "of_cell", "part": "of_part", "ids": "data_ids", "p": "data_p"})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, tree = np.frombuffer(right["data_ids"][0].as_py(), np.int64), holding(unpacked(right["data_p"][0].as_py(), size), LEAF)
        out = [np.zeros((4, 0), np.int64)]
        for qids, h, p, floor in zip(*(left[c].to_pylist() for c in ("ids", "h", "p", "floor")), strict=True):
            qids, h = np.frombuffer(qids, np.int64), np.frombuffer(h, np.int64)
            at, found, scores = dual_tree(unpacked(p, size), qids, tree, ids, k, np.frombuffer(floor))
            out.append(np.stack([qids[at], h[at], found, scores.astype(np.int64)]))
        return pa.table(list(map(pa.array, np.concatenate(out, axis=1))), names=FOUND.names)

    result = "query_id long, h long, vec_id long, score long"
    others = asked.groupBy("to_cell", "to_part", "chunk").cogroup(met.groupBy("of_cell", "of_part", "of_chunk")).applyInArrow(search, result)
    every = groups.select(F.inline("found")).unionByName(others)
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    merged = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(k: int = K, scale: int = SCALE, every: int = 20) -> str:
    """The same for vectors of one length without repeated rows."""
    return f"""
WITH points AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.p AS DOUBLE[]), CAST(d.p AS DOUBLE[])) AS BIGINT) AS score
    FROM points q JOIN points d ON q.vec_id <> d.vec_id WHERE q.vec_id % {every} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= {k}
"""
