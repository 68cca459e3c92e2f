import random

import numpy as np
import pytest
import xxhash

from wavemill.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values):
    label = list(range(len(values)))
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    for _ in values:
        new = [min(label[j] for j in np.flatnonzero(row)) for row in near]
        if new == label:
            break
        label = new
    return label


def test_whole_query_is_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices("the of and zu é lo wa ki".split() + [f"w{i}" for i in range(50)], k=n)) for n in (1, 2, 3, 4, 40, 200, 900)]
    texts = ["", None, "  ", "One", "one", *base, *base[3:]]
    for text in base[4:]:
        for _ in range(12):
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fps = [brute_fingerprint(x) for x in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)


def test_links_and_chains(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(50)}
    for v in list(values):
        for _ in range(6):  # chains, each step two bits at most
            v ^= 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
            values.add(v)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {tuple(r) for r in simhash.links(nodes).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_nulls_repeats_and_stage(spark):
    rows = [(3, "a b c d", "x"), (3, "a b c d", "y"), (None, "a b c d", "z"), (7, None, "q"), (9, "", "q"), (None, "only here now", "k"), (12, "A b C d", "o")]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(d).collect())
    assert got == sorted([("3", "3"), ("3", "3"), ("None", "3"), ("7", "7"), ("9", "7"), ("None", "None"), ("12", "3")])
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "7", "None", "None"])
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    a, b, c = "a text of its own", "quite another one here", "copies without any id"
    rows = [(5, a), (5, b), (9, b), (6, a), (8, "words that nobody repeats"), *[(None, c)] * 40, (None, "left alone too")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, [(5, a), (5, b), (8, "words that nobody repeats"), (None, c), (None, "left alone too")]))
    for n in (1, 7):
        assert sorted(str(tuple(r)) for r in simhash.drop_near_duplicates(d.repartition(n)).collect()) == want


@pytest.mark.parametrize("hot", [2080, 3, 0])
def test_links_are_those_of_all_pairs_with_hot_halves(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
        fps |= {base & 0xFFFFFFFF | rng.getrandbits(32) << 32 for _ in range(6)} | {base ^ 1 << 63, base ^ 3 << 62, base ^ 1}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want and len(want) > 100
