import random

import numpy as np
import pytest

from wavemill.llm import bond


def brute(rows, every, positives=5, negatives=3):
    points = [(v, label, np.floor(256 * np.array(e, float))) for v, label, e in rows if v is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for v, label, p in points:
        if v % every:
            continue
        scored = sorted((-int(p @ q), w, other) for w, other, q in points if w != v)
        near = [(w, -s) for s, w, other in scored if other == label][:positives]
        for w, goal in near:
            hard = [(x, -s) for s, x, other in scored if other != label and 50 * goal <= -100 * s <= 95 * goal][:negatives]
            out += [(v, w, i, x, goal, s) for i, (x, s) in enumerate(hard, 1)]
    return sorted(out)


def rows_of(seed, n=400, size=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size)) * 0.3
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + rng.normal(size=size) * 0.15).round(3).tolist()) for i in range(n)]
    rows += [(n + i, 1, rows[0][2]) for i in range(40)] + [(2 * n + i, 2, rows[0][2]) for i in range(40)]  # ties
    return rows + [(None, 1, rows[1][2]), (5000, None, rows[1][2]), (5010, 1, None), (5020, 2, [None] * size), (5030, 1, [float("nan")] * size), (5040, 1, [float("inf")] * size)]


@pytest.mark.parametrize(("block", "chunk"), [(8192, 1024), (64, 7)])
def test_whole_query_is_brute_force(spark, block, chunk):
    rows = rows_of(block)
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    from pyspark.sql import functions as F

    found = bond.mine(d, F.col("vec_id") % 10 == 0, block=block, chunk=chunk).collect()
    assert sorted(map(tuple, found)) == brute(rows, 10)
    assert len(found) > 100


def test_bitmap_shrinks_before_the_last_dimension():
    rng = np.random.default_rng(2)
    n, size = 2000, 64
    centres = rng.normal(size=(20, size)) * 60
    p = (centres[rng.integers(20, size=n)] + rng.normal(size=(n, size)) * 10).astype(np.int64)
    there = bond.Vertical(bond.packed(np.ascontiguousarray(p.T)), size, np.arange(n), np.zeros(n, np.int64))
    left = []

    def shrink(lower, upper):
        keep = upper >= np.partition(lower, len(lower) - 5)[len(lower) - 5] if len(lower) > 5 else np.ones(len(lower), bool)
        left.append(int(keep.sum()))
        return keep

    alive, scores = there.scan(p[0].astype(float), np.arange(n), shrink)
    assert set(np.argsort(-(p @ p[0]), kind="stable")[:5]) <= set(alive.tolist()) and (scores == p[alive] @ p[0]).all()
    assert left[len(left) // 2] < n / 2 and left == sorted(left, reverse=True)


def test_repeats_clashing_names_few_rows_and_empty(spark):
    from pyspark.sql import functions as F

    rows = [(0, 1, [1.0, 0.0], "x"), (0, 1, [1.0, 0.0], "y"), (1, 1, [1.0, 0.1], "z"), (2, 2, [0.8, 0.0], "n"), (3, 2, [0.8, 0.0], "n"), (0, 2, [0.9, 0.0], "own id"), (4, 1, [0.5], "other length"), (5, 1, [], "empty")]
    d = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>, h string")
    got = sorted(map(tuple, bond.mine(d, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 2, 65536, 256 * 204), (0, 1, 2, 3, 65536, 256 * 204)]
    assert bond.mine(d.limit(0), F.col("vec_id") == 0).count() == 0
    assert bond.mine(d.where("label = 2"), F.col("vec_id") == 2).count() == 0
