import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import topk


def brute(ids, p, k, every=20):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        scores = p @ p[i]
        best = sorted((-int(scores[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out += [(int(ids[i]), n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def clustered(n, size, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, size))[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, size))
    return np.arange(n), np.floor(64 * x.astype(np.float32).astype(float)).astype(int), x.astype(np.float32)


@pytest.mark.parametrize("spread", [0.05, 1.0, 0.0])
def test_is_brute_force(spark, spread):
    ids, p, x = clustered(700, 8, spread)
    rows = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score int")
    got = topk.top_k(rows, F.pmod("vec_id", F.lit(20)) == 0, k=7, block=64, group=16).collect()
    assert sorted(map(tuple, got)) == brute(ids, p, 7)


def test_pruning_leaves_pairs_out():
    _, p, _ = clustered(3000, 8, 0.01)
    seen, product = [], topk.best
    topk.best = lambda *a: seen.append(1) or product(*a)
    try:
        topk.dual_tree(p[:50], np.arange(50), p, np.arange(3000), 5, np.full(50, -1e300))
    finally:
        topk.best = product
    assert len(seen) < 50 * 3000 / 64


def test_nulls_repeats_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [9.0, 9.0]), (7, [1.0]), (20, [-1.0, 0.0]), (8, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = F.pmod("vec_id", F.lit(20)) == 0
    got = sorted(map(tuple, topk.top_k(d, ask, k=3).collect()))
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 20, -4096), (20, 1, 0, -4096), (20, 2, 1, -4096), (20, 3, 2, -4096)]
    assert topk.top_k(d.limit(0), ask).count() == 0


@pytest.mark.parametrize("size, spread", [(3, 0.3), (64, 1.0), (64, 0.01)])
def test_levels_cover_and_are_separated(size, spread):
    _, p, _ = clustered(1200, size, spread)
    p = np.unique(np.r_[p, p[:50]], axis=0)
    tree = topk.CoverTree(p, 90).hold()
    assert sorted(tree.order) == list(range(len(p)))
    by_level = {}
    for i, level in enumerate(tree.level):
        by_level.setdefault(level, []).append(i)
        mine = tree.sorted[tree.first[i] : tree.past[i]]
        assert np.sqrt(((mine - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i]
        for child in tree.children[i]:  # covering, by the parent's radius
            gap = np.linalg.norm(tree.centre[child] - tree.centre[i])
            assert gap <= tree.apart[1] / 2 ** (tree.level[child] - 1) + 1e-6
            assert tree.first[i] <= tree.first[child] and tree.past[child] <= tree.past[i]
    for level in range(1, max(by_level) + 1):
        net = np.stack(list({tuple(tree.centre[i]) for lower in range(level + 1) for i in by_level.get(lower, ())}))
        away = np.linalg.norm(net[:, None] - net[None], axis=2)[~np.eye(len(net), dtype=bool)]
        assert away.min() > tree.apart[1] / 2**level - 1e-6


def test_sixty_four_dimensions_leave_pairs_out():
    _, p, _ = clustered(20_000, 64, 0.02)
    ids = np.arange(len(p))
    seen, product = [], topk.best
    topk.best = lambda *a: seen.append(1) or product(*a)
    try:
        at, found, scores = topk.dual_tree(p[:2000].astype(float), ids[:2000], p, ids, 5, np.full(2000, -np.inf))
    finally:
        topk.best = product
    leaves = -(-2000 // topk.QUERY_LEAF) * -(-20_000 // topk.LEAF)
    assert len(seen) < leaves / 2
    i = 77
    want = sorted((-int(s), j) for j, s in enumerate(p @ p[i]) if j != i)[:5]
    assert sorted((-int(s), int(j)) for j, s in zip(found[at == i], scores[at == i])) == want


def test_groups_walk_past_blocks(spark):
    """Of separate clusters, a group meets few blocks; the result is that of brute force."""
    rng = np.random.default_rng(5)
    axes = 20 * np.eye(16)[rng.integers(0, 16, 1500)]
    x = (axes + 0.02 * rng.normal(size=axes.shape)).astype(np.float32)
    ids, p = np.arange(1500), np.floor(64 * x.astype(float)).astype(int)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = topk.top_k(rows, F.pmod("vec_id", F.lit(20)) == 0, k=4, block=40, group=8, groups_at_once=3)
    assert sorted(map(tuple, got.collect())) == brute(ids, p, 4)
