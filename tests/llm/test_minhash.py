import random

import numpy as np
import pytest

from wavemill.llm import minhash


def brute(texts):
    """Sets of shingle texts, and the components of all pairs that are similar enough."""
    sets = []
    for text in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(texts)))
    near = [[j for j in range(len(sets)) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])] or [i] for i in range(len(sets))]
    while (new := [min(label[j] for j in row) for row in near]) != label:
        label = new
    return [len(s) for s in sets], label


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = "the of and zu é lo wa ki".split() + [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=k)) for k in (1, 2, 4, 5, 6, 7, 12, 40, 60, 200, 300, 900)]
    passage = " ".join(rng.choices(vocabulary, k=20))
    texts = ["", None, "  ", "One", "one", *base, *base[3:], *[f"{passage} {rng.random()}" for _ in range(20)]]
    for text in base[4:]:
        for _ in range(n):
            words = text.split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1, 2])] = ["changed" + str(rng.randrange(3))]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1024, 16])
def test_whole_query_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus(block, 40)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sizes, label = brute(texts)
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == label
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_registers_and_estimates():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    for some in (h[:1], h[:50], h, np.array([0, 1, 2**40 - 1, 2**64 - 1], np.uint64)):
        want = {}
        for x in some.tolist():
            bucket, value = (x >> 40) * minhash.BUCKETS >> 24, x & (1 << 40) - 1
            want[bucket] = min(want.get(bucket, 1 << 40), value)
        got = minhash.registers(some)
        assert {int(i) for i in np.flatnonzero(got)} == set(want)
        for bucket, value in want.items():  # leading zeros and one more, then the bits after the leading one
            value = max(value, 1)
            bits = f"{value:040b}"
            zeros = len(bits) - len(bits.lstrip("0"))
            rest = (bits[zeros + 1 :] + "0" * 10)[:10]
            assert got[bucket] == (zeros + 1) << 10 | int(rest, 2), (bucket, value)
    # registers of different least hashes agree about as often as the correction says
    codes = [minhash.registers(rng.integers(0, 2**64, 4000, dtype=np.uint64)) for _ in range(400)]
    same = np.mean([(a == b).mean() for a, b in zip(codes[::2], codes[1::2], strict=True)])
    chance = float(minhash.by_chance(np.array([4000.0]), np.array([4000.0]))[0])
    assert 0.5 * chance < same < 1.6 * chance
    # and an estimate of a known similarity is near it
    shared, a, b = np.split(h[rng.permutation(len(h))[:4800]], [4000, 4400])
    x, y = (minhash.registers(np.sort(np.concatenate([shared, z]))) for z in (a, b))
    got, margin = minhash.estimated(np.array([((x == y) & (x > 0)).sum()]), np.array([((x > 0) | (y > 0)).sum()]), np.array([4400]), np.array([4400]))
    assert abs(got[0] - 4000 / 4800) < margin[0]


def test_nulls_repeats_clashing_names_and_empty(spark):
    rows = [(3, "a b c d", "x"), (3, "a b c d", "y"), (None, "A b c d", "z"), (7, None, "q"), (9, "", "q"), (None, "only here now", "k"), (None, None, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnsRenamed({"key": "key"})
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(d).collect())
    assert got == sorted([("3", 1, "3", True), ("3", 1, "3", True), ("None", 1, "3", False), ("7", 0, "7", True), ("9", 0, "9", True), ("None", 1, "None", True), ("None", 0, "None", True)])
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    other = [*words[:150_000], "x", *words[150_000:]]
    d = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(other)), (4, "z" * 3_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()} == {2: 1, 1: 1, 4: 4}
