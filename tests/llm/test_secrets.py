import hashlib
import random
import re
import time

from wavemill.llm import secrets

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
BLOB = "wJalrXUtnFEMI1K7MDENGbPxRfiCYzEXAMPLEKEY"
TEXTS = [
    "", "plain text only", "password=hunter2hunter2", "token: secret: abcdefgh12 and SECRET = 'abcdefgh'", "Token=short pass", f"é😀 {KEY} x AKIASHORT {KEY}",
    "a" * 31 + " " + "0a" * 16 + "é" + "f" * 40, "api_key:'0123456789abcdef0123456789abcdef' " + KEY, f"{BLOB} stands alone", f"user_id https://x.example.org/a {BLOB}",
    f"login = admin\nblob {BLOB} at https://db.example.org:5432/x", f"{KEY} " + "x " * 300 + BLOB, f"client_id=abc123 " + "y" * 150 + f" {BLOB} 10.0.0.1:8080",
    "token==abcdefg password:token=12345678", "secret=abcdefgh" * 200, ("AKIA" * 6 + " ") * 150 + "ß",
]


def spans(text):
    found = [("assign", *m.span()) for m in re.finditer(secrets.ASSIGN, text, re.A) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    weak = [(kind, *m.span()) for kind in ("ident", "blob", "endpoint") for m in re.finditer(secrets.KINDS[kind], text)]
    near = lambda x, kinds: any(y[0] in kinds and y[1] <= x[2] + 200 and x[1] <= y[2] + 200 for y in found + weak)
    ids, keys = ("access", "ident"), ("assign", "hex", "blob")
    linked = [x for x in weak if {"ident": near(x, keys), "blob": near(x, ids), "endpoint": near(x, ids) and near(x, keys)}[x[0]]]
    order = lambda xs: sorted(xs, key=lambda x: (x[1], list(secrets.KINDS).index(x[0])))
    return order(found), order(found + linked)


def listed(xs):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in xs)


def redacted(text):
    want, kept = "", 0
    for k, a, b in spans(text)[1]:
        if k != "endpoint":
            want, kept = (want + text[kept:a] + "[REDACTED]", b) if a > kept or not kept else (want, max(kept, b))
    return want + text[kept:]


def test_scan_is_brute_force(spark):
    rows = [*enumerate(TEXTS), (None, None), (3, TEXTS[3])]
    got = secrets.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")).collect()
    want = []
    for i, text in rows:
        base, every = spans(text or "")
        want.append((str(i), *[sum(x[0] == k for x in base) for k in secrets.BASE], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_weak_parts_count_only_together():
    assert listed(spans(TEXTS[8])[1]) == "" and listed(spans(TEXTS[9])[1]) == ""
    assert [x[0] for x in spans(TEXTS[10])[1]] == ["ident", "blob", "endpoint"]
    assert [x[0] for x in spans(TEXTS[11])[1]] == ["access"]


def test_redaction(spark):
    d = spark.createDataFrame([(i, x, "y") for i, x in enumerate([*TEXTS, None])], "doc_id long, text string, spans_all string")
    out = secrets.redact(d)
    assert out.columns == d.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == redacted(text)
    assert got[len(TEXTS)] is None


def test_empty(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_parts_in_one_text(spark):
    """Against brute force over every pair, with parts at all distances around SCOPE; pieces longer than a stretch."""
    rng = random.Random(5)
    parts = ["user_id=bob", BLOB, "https://x.example.org/a", KEY, "0a" * 20, "secret=abcdefgh", "10.0.0.1:80", "😀"]
    texts = [" ".join(rng.choice(parts) + " é" * rng.choice([0, 3, 60, 99, 100, 101, 300]) for _ in range(n)) for n in (1, 63, 64, 65, 66, 130, 700)]
    texts += [f"{KEY} " + "é😀" * 5000 + f" {KEY}{' x' * 2043} {KEY}", "z" * secrets.STRETCH + f" {KEY}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.scan(d).collect()} == {i: listed(spans(x)[1]) for i, x in enumerate(texts)}
    for r in secrets.redact(d).collect():
        assert r.text == redacted(texts[r.doc_id])


def test_a_hundred_thousand_spans_take_linear_time(spark):
    unit = f"login=admin {BLOB} https://x.example.org/a token=abcdefgh1\n"
    n = 25_000
    d = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
    began = time.time()
    row = secrets.scan(d).first()
    assert row.n_assign == n and row.spans.count(",") == 4 * n - 1 and row.spans.endswith(listed([("assign", len(unit) * n - 16, len(unit) * n - 1)]))
    assert secrets.redact(d).first().text == redacted(unit) * n
    assert time.time() - began < 60  # the square of the spans would take hours
