import hashlib
import re

from wavemill.llm import decontam

FILLER = [f"w{i}" for i in range(400)]


def brute(text, items, size=13, one_in=20):
    fold = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, named = fold(text), set(), set()
    for item, passage in items:
        w = fold(passage)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    named.add(item)
    named = sorted(str(x) for x in named if x is not None)
    return len(words), len(hit), named, len(hit) > 0 and one_in * len(hit) >= len(words)


def cases(spark):
    items = [(1, " ".join(FILLER[:30])), (20, "Short item"), (3, None), (4, "!!"), (None, " ".join(FILLER[40:60])), (1, "tiny"), (5, " ".join(["ha"] * 20))]
    docs = [
        (0, " ".join(FILLER[5:20]) + " END"), (1, " ".join(FILLER[:12])), (2, None), (3, ""), (4, "a SHORT  item, twice short-item"),
        (5, " ".join(FILLER[100:390] + FILLER[2:16])), (None, " ".join(FILLER[38:58])), (7, "ha " * 50), (7, "ha " * 50), (8, "x " * 5000 + "short item"), (9, "Éa tiny"),
    ]
    return docs, items, spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")


def test_scan_is_brute_force(spark):
    docs, items, d, b = cases(spark)
    for broadcast_bytes in (1 << 20, 60):  # one part, several parts
        got = decontam.scan(d, b, broadcast_bytes=broadcast_bytes).collect()
        want = sorted((str(i), *brute(text, items)) for i, text in docs)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == want
        assert all(r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() and r.n_items == len(r["items"]) for r in got)


def test_removal(spark):
    docs, items, d, b = cases(spark)
    for broadcast_bytes in (1 << 20, 60):
        kept = decontam.decontaminate(d, b, broadcast_bytes=broadcast_bytes)
        assert kept.columns == d.columns
        assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((i, t)) for i, t in docs if not brute(t, items)[3])
        cut = decontam.decontaminate(d, b, remove="spans", broadcast_bytes=broadcast_bytes).collect()
        assert len(cut) == len(docs)
        assert {r.doc_id: r.text for r in cut}[4] == "a , twice " and {r.doc_id: r.text for r in cut}[2] is None


def test_spans_of_several_parts_are_those_of_one(spark):
    items = [(i, " ".join(FILLER[7 * i : 7 * i + 20])) for i in range(12)]
    docs = spark.createDataFrame([(0, "before " + " ".join(FILLER[:97]) + " after")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for broadcast_bytes in (1 << 20, 400, 100):
        assert decontam.decontaminate(docs, b, remove="spans", broadcast_bytes=broadcast_bytes).first().text == "before  after"


def test_empty(spark):
    _, _, d, b = cases(spark)
    assert decontam.scan(d.limit(0), b).count() == 0
    assert decontam.scan(d, b.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_long_items_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 5)
    items = [(1, " ".join(FILLER[:200])), (2, " ".join(FILLER[300:313])), (3, "tiny one")]
    docs = [(i, " ".join(FILLER[i * 13 : i * 13 + 20])) for i in range(25)] + [(99, "a Tiny one")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), b, broadcast_bytes=1000).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == sorted((i, *brute(t, items)) for i, t in docs)


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam.Windows, "hash", lambda self, ids, at, size: (ids[at] % 2).astype("u8"))
    items = [(str(i), " ".join(FILLER[i : i + 15]).encode()) for i in range(0, 60, 3)]
    windows = decontam.Windows(items)
    for a in range(0, 50, 7):
        text = " ".join([*FILLER[a : a + 16], "x", *FILLER[a + 20 : a + 33]])
        hit, named = windows.match(decontam.words(text.encode()))
        want = brute(text, [(i, t.decode()) for i, t in items])
        assert (int(hit.sum()), sorted(named)) == (want[1], want[2])


def test_windows_take_little_room():
    import pickle

    rng = __import__("random").Random(1)
    items = [(str(i), " ".join(rng.choices(FILLER, k=200)).encode()) for i in range(1000)]
    assert len(pickle.dumps(decontam.Windows(items))) < 8 * sum(len(t) for _, t in items)


def test_twenty_parts_write_masks_only(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(decontam, "written", lambda df, write=decontam.written: (wrote.append(df.columns), write(df))[1])
    items = [(i, " ".join(FILLER[i : i + 15])) for i in range(0, 120, 2)]
    texts = [" ".join(FILLER[a : a + 40] + ["x"] * a) for a in range(0, 150, 5)]
    docs = [*enumerate(texts), *[(1000 + i, texts[0]) for i in range(60)], (None, texts[3]), (7, None), (8, "")]
    size = sum(len(text) for _, text in items)
    d, b = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, key string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *brute(text, items)) for i, text in docs)
    for most in (size // 20, size // 2):  # united hits are shuffled, or broadcast
        wrote.clear()
        got = decontam.scan(d, b, broadcast_bytes=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == want
        assert len(wrote) >= (20 if most == size // 20 else 2) and all("text" not in columns for columns in wrote)
        kept = decontam.decontaminate(d, b, broadcast_bytes=most).collect()
        assert sorted(str((r.doc_id, r.text, r.key)) for r in kept) == sorted(str((i, t, "k")) for i, t in docs if not brute(t, items)[3])
        cut, whole = (decontam.decontaminate(d, b, remove="spans", broadcast_bytes=x) for x in (most, 1 << 20))
        assert cut.columns == d.columns and sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
