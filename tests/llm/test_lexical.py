import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from wavemill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    words = [(doc, Counter(split(text)), len(split(text))) for doc, text in docs]
    n, length = sum(size > 0 for *_, size in words), sum(size for *_, size in words)
    df = Counter(w for _, counted, _ in words for w in counted)
    out = []
    for item, text in items:
        scores = []
        for doc, counted, size in words:
            m = 25 + 75 * size * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * counted[w] // (1000 * counted[w] + 8 * m)) for w in split(text) if w in counted)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, i, None if null else doc, -score) for i, (score, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def tables(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "The", "É1", "zu"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i * 3 % 1009, rng.choice([" ", "-", "_"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 60])))) for i in range(n)]
    docs += [(5000 + i, docs[0][1]) for i in range(60)]  # ties
    docs += [(None, docs[1][1]), (7000, None), (7001, ""), (7002, "--- ..."), (7003, docs[2][1]), (7003, docs[2][1]), (7004, "w3 " * 5000)]
    items = [(f"i{j}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 30])))) for j in range(25)] + [("none", None), ("empty", ""), ("unknown", "qqq"), (None, "w1 w2"), ("twice", "w3 w3 w4")]
    return docs, items


@pytest.mark.parametrize(("shard", "leaf", "most"), [(1 << 18, 1024, 8 << 20), (700, 8, 600)])
def test_whole_query_is_brute_force(spark, monkeypatch, shard, leaf, most):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    docs, items = tables(leaf)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([*items, items[0]], "item_id string, text string")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.rank(d, i, broadcast_bytes=most, shard=shard).collect()), key=str)
    assert got == brute(docs, items)


def test_intervals_are_left_out_and_exact():
    """Best-first intervals find what a scan of all postings finds, by any number of splits."""
    rng = np.random.default_rng(3)
    n, vocabulary = 3000, 40
    at, words = zip(*[(d, w) for d in range(n) for w in np.flatnonzero(rng.random(vocabulary) < 0.3).tolist()], strict=True)
    at, words = np.array(at), np.array(words)
    impact = rng.choice([3, 10, 50, 999_999], len(at), p=[0.5, 0.3, 0.19, 0.01])
    ids = rng.permutation(n).tolist()
    index = lexical.Shard(ids, words, at, impact, vocabulary)
    for _ in range(20):
        mine = rng.choice(vocabulary, rng.integers(1, 12), replace=False)
        weights = rng.integers(0, 5, len(mine))
        scores = np.zeros(n, np.int64)
        for w, x in zip(mine, weights, strict=True):
            np.add.at(scores, at[words == w], x * impact[words == w])
        want = sorted((-int(s), (False, ids[d])) for d, s in enumerate(scores) if s > 0)[:10]
        best = []
        index.search(mine, weights, 10, best)
        assert best == want


def test_sql_agrees(spark):
    docs, items = tables(9, 150)
    docs = [row for row in docs if row[0] is not None and row[0] != 7003]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)"), con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id VARCHAR, text VARCHAR)"), con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(lexical.SQL).fetchall(), key=str) == brute(docs, items)


def test_empty_tables_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, words string, n int")
    i = spark.createDataFrame([(4, "a", "y")], "item_id int, text string, doc_id string")
    assert [tuple(r)[:3] for r in lexical.rank(d, i).collect()] == [(4, 1, 1)]
    assert lexical.rank(d.limit(0), i).count() == 0 and lexical.rank(d, i.limit(0)).count() == 0
