import collections
import math
import random

import numpy as np
import pytest

from wavemill.llm import quality

GOOD, BAD = [f"word{i}" for i in range(60)], [f"junk{i}!!" for i in range(20)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        words = rng.choices(GOOD if good else GOOD[:10] + BAD, k=rng.randint(20, 60)) + ["scum", "moron"] * toxic
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", f"s{i % 7}", "clash"))
        labels.append((i, int(good), int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, quality string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy(spark, tables):
    d, lab, labels = tables
    got = {r.doc_id: r for r in quality.classify(d, lab.where("doc_id < 400")).collect()}
    held = [x for x in labels if x[0] >= 400]
    assert len(got) == 600
    assert np.mean([(got[i].quality >= 0.5) == q for i, q, _ in held]) > 0.97
    assert np.mean([(got[i].toxic >= 0.5) == t for i, _, t in held]) > 0.97
    assert all(r.keep == (r.quality >= 0.5 and r.toxic < 0.5) for r in got.values())


def test_stage_keeps_what_the_query_keeps(spark, tables):
    d, lab, _ = tables
    classifier = quality.fit(d, lab)
    kept = quality.keep_good(d, lab, classifier=classifier)
    assert kept.columns == d.columns
    want = {r.doc_id for r in quality.classify(d, lab, classifier=classifier).where("keep").collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_posteriors_are_the_grouped_ones(spark):
    rng = random.Random(1)
    rows = [(f"h{i % 9}", f"p{i % 4}", min(0.99, max(0.01, rng.gauss(0.1 * (i % 9 + 0.5), 0.1))), 0.2) for i in range(900)] + [("tiny", "p", 0.99, 0.2)]
    got = {(r.host, r.path): r.quality_shift for r in quality.sites(spark.createDataFrame(rows, "host string, path string, quality double, toxic double")).collect()}
    n, mean = len(rows), sum(r[2] for r in rows) / len(rows)
    by = lambda key: {k: [r[2] for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = by(lambda r: r[0]), by(lambda r: r[:2])
    k = lambda spread: max(1, min(1e6, mean * (1 - mean) / max(spread, 1e-9) - 1))
    hk = k(sum(len(x) * (np.mean(x) - mean) ** 2 for x in hosts.values()) / n - mean * (1 - mean) * len(hosts) / n)
    h = {name: (sum(x) + hk * mean) / (len(x) + hk) for name, x in hosts.items()}
    pk = k(sum(len(x) * (np.mean(x) - h[name[0]]) ** 2 for name, x in paths.items()) / n - mean * (1 - mean) * len(paths) / n)
    for name, x in paths.items():
        p = (sum(x) + pk * h[name[0]]) / (len(x) + pk)
        assert got[name] == pytest.approx(math.log(p / (1 - p)) - math.log(mean / (1 - mean)), abs=1e-6)
    alone = math.log(0.99 / 0.01) - math.log(mean / (1 - mean))
    assert got["tiny", "p"] < 0.9 * alone  # one document cannot speak for its site


def test_nulls_empty_and_no_labels(spark, tables):
    d, lab, _ = tables
    odd = spark.createDataFrame([(None, None, None, None, "x"), (1, "", "en", "s1", "x"), (1, "word1 " * 5000, "en", None, "x"), (1, "", "en", "s1", "x")], d.schema)
    assert quality.classify(odd, lab.withColumn("toxic", lab.toxic * None)).where("keep is null").count() == 0
    got = quality.classify(odd, lab.limit(0)).collect()
    assert len(got) == 4 and all(r.doc_quality == 0.5 and r.doc_toxic < 1e-6 for r in got)
    assert quality.classify(d.limit(0), lab).count() == 0 and quality.keep_good(d.limit(0), lab).count() == 0


def test_many_sites_keep_what_few_do(spark, tables, monkeypatch):
    d, lab, _ = tables
    d = d.union(d.limit(40)).union(spark.createDataFrame([(None, None, None, None, "x"), (-1, "", "en", "s1", "x")], d.schema))
    classifier = quality.fit(d, lab)
    want, rows = (sorted(map(str, x.collect())) for x in (quality.keep_good(d, lab, classifier=classifier), quality.classify(d, lab, classifier=classifier)))
    for most in (6, 300, 1):  # rejected keys are shuffled, or broadcast
        monkeypatch.setattr(quality, "MOST_SITES", most)
        monkeypatch.setattr(quality, "few", lambda table, n, few=quality.few, most=most: few(table, 6 if "path" in table.columns else most))
        kept = quality.keep_good(d, lab, classifier=classifier)
        assert kept.columns == d.columns and sorted(map(str, kept.collect())) == want
        assert [x.split(", quality=")[0] for x in sorted(map(str, quality.classify(d, lab, classifier=classifier).collect()))] == [x.split(", quality=")[0] for x in rows]


def test_a_hundred_thousand_sites(spark, tables):
    d, lab, _ = tables
    classifier = quality.fit(d, lab)
    n = quality.MOST_SITES + 1
    docs = spark.range(n).selectExpr("id AS doc_id", "if(id % 3 = 0, 'junk1!! junk2!! word1', 'word11 word12 word13') AS text", "'en' AS lang", "concat('s', id) AS source")
    docs = docs.union(spark.range(20_000).selectExpr("-id", "'word20 word21 word22'", "'en'", "'s0'"))  # a hot site
    kept = quality.keep_good(docs, lab, classifier=classifier)
    got, each = {r.doc_id for r in kept.select("doc_id").collect()}, quality.classify(docs, lab, classifier=classifier)
    assert got == {r.doc_id for r in each.where("keep").select("doc_id").collect()} and 20_000 < len(got) < n + 20_000
    assert each.count() == n + 20_000


def test_long_texts_lose_words_by_hash_only():
    words = [b"w%06d" % i for i in range(30_000)]
    short, text = quality.of_text(b" ".join(words[:100] * 2)), b" ".join(words)
    assert len(short) == 300 + 24 and short[-24:] == [x for x in quality.repetition(200, 100) for _ in range(8)]
    got = quality.of_text(text)
    assert len(got) <= quality.MOST_FEATURES and got[-24:] == [x for x in quality.repetition(30_000, 30_000) for _ in range(8)]
    shared = collections.Counter(quality.features(word)[0] for word in words)
    lone = {x: i for i, word in enumerate(words) if shared[x := quality.features(word)[0]] == 1}
    kept = [lone[x] for x in got[:-24:3] if x in lone]
    assert abs(np.mean(kept) - 15_000) < 600  # from all of the alphabet
