import hashlib
import random
from collections import defaultdict

import pytest

from wavemill.llm import sharding


def brute(rows, limit):
    def bits(i):
        return f"{int(hashlib.md5(str('' if i is None else i).encode()).hexdigest()[:15], 16):060b}"

    def split(bucket, depth):
        if sum(b for _, b in bucket) <= limit or len(bucket) == 1 or depth == 60:
            return [(bits(bucket[0][0])[:depth], bucket)] if bucket else []
        return [x for bit in "01" for x in split([r for r in bucket if bits(r[0])[depth] == bit], depth + 1)]

    return {i: (shard, sum(b for _, b in bucket), len(bucket)) for shard, bucket in split(rows, 0) for i, _ in bucket}


@pytest.mark.parametrize("limit", [40, 300, 5000, 10**9])
def test_is_split_as_by_brute_force(spark, limit):
    rng = random.Random(limit)
    rows = [(i, "é" * rng.choice([0, 1, 5, 30, 200])) for i in range(400)] + [(None, "a null id"), (1000, None)]
    want = brute([(i, len((t or "").encode())) for i, t in rows], limit)
    got = sharding.assign(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string"), limit).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.shard, r.shard_bytes, r.shard_docs) for r in got} == want
    assert all(r.shard_bytes <= limit or r.shard_docs == 1 for r in got) and all(r.depth == len(r.shard) for r in got)


def test_repeated_ids_overflow(spark):
    rows = [(7, "x" * n) for n in [10] * 200 + [90, 60, 60, 500]] + [(i, "y" * 20) for i in range(20, 60)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()
    sizes = defaultdict(list)
    for r in got:
        sizes[r.shard].append(r)
    assert len(got) == len(rows)
    assert all(sum(r.n_bytes for r in x) == x[0].shard_bytes and len(x) == x[0].shard_docs for x in sizes.values())
    assert all(sum(r.n_bytes for r in x) <= 100 or len(x) == 1 for x in sizes.values())


def test_empty_and_write(spark, tmp_path):
    d = spark.createDataFrame([(i, "z" * 50) for i in range(30)], "doc_id long, text string")
    assert sharding.assign(d.limit(0)).count() == 0
    sharding.write(d, f"{tmp_path}/out", 200)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 30 and back.groupBy("shard").count().where("count > 4").count() == 0


def test_write_keeps_repeated_ids_and_clashing_columns(spark, tmp_path):
    rows = [(7, "x" * n, "s", n) for n in [10] * 40 + [90, 60, 60]] + [(i, "y" * 20, None, i) for i in range(20, 60)] + [(None, None, "row", -1)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string, row int").repartition(3)
    sharding.write(d, f"{tmp_path}/out", 100)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.shard, r.row) for r in back))) == sorted(map(str, rows))
    sizes = defaultdict(list)
    for r in back:
        sizes[r.shard_].append(len(r.text or ""))
    assert all(sum(x) <= 100 or len(x) == 1 for x in sizes.values())


def test_deep_tries_go_in_strides(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRIDE", 3)
    monkeypatch.setattr(sharding, "FEW_BITS", 4)
    rows = [(i, "z" * (i % 50)) for i in range(500)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 60).collect()
    assert {r.doc_id: (r.shard, r.shard_bytes, r.shard_docs) for r in got} == brute([(i, len(t)) for i, t in rows], 60)
