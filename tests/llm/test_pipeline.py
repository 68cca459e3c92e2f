"""The pipeline's stages, each held against a brute-force version over what the stage before kept."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_decontam import brute as brute_hits
from test_secrets import BLOB, KEY, spans
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as P
from wavemill.llm import bpe, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, spans_all string, row int, of_host string, fp long"


def made(rng):
    good, bad, toxic = ([f"{p}{i}" for i in range(120)] for p in ("fine", "junk", "vile"))
    rows, labels = [], []

    def add(text, kind=None, doc_id=None):
        i = len(rows) if doc_id is None else doc_id
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b"]), None if text is None else len(text), "clash", None, 7, "x", i or 0))
        if kind:
            labels.append((i, int(kind != "bad"), int(kind == "toxic")))

    for n in range(240):
        kind = ("good", "good", "bad", "toxic")[n % 4]
        add(" ".join(rng.choices({"good": good, "bad": bad, "toxic": toxic}[kind], k=rng.randint(20, 60))), kind if n < 200 else None)
    passage = " ".join(rng.sample(good, 30))
    for _ in range(3):
        add(" ".join(rng.choices(good, k=40)) + " " + passage)
    for _ in range(4):
        add(f"{' '.join(good[:50])}")  # copies
    add(" ".join(rng.choices(good, k=30)) + f" password=hunter2hunter2 é {KEY} x {BLOB} end")
    add(None), add(""), add(""), add("  ")
    rows.append(rows[0]), rows.append((None, *rows[1][1:])), rows.append((None, *rows[1][1:]))
    return rows, labels, [(1, passage), (2, None), (3, "!!")]


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = made(random.Random(3))
    write(spark, folder, rows, labels, items)
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        out.append((name, docs.collect(), spark.read.parquet(f"{folder}/{name}").collect()))
        docs = spark.read.parquet(f"{folder}/{name}")
    return folder, items, {name: (before, after) for name, before, after in out}


def same(found, want):
    return sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, want)))


def test_quality_keeps_what_the_posteriors_say(spark, stages):
    folder, _, by = stages
    before, after = by["quality"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = quality.Scorer(quality.fit(docs, labels))
    scored = [(*((x or "") for x in (r.source, r.lang)), *scorer((r.text or "").encode())) for r in before]
    evidence = spark.createDataFrame(scored and [(a, b, float(q), float(t)) for a, b, q, t in scored], "host string, path string, quality double, toxic double")
    shift = {(s.host, s.path): s for s in quality.sites(evidence).collect()}
    odds = lambda p: np.log(p / (1 - p))
    want = [r for r, (a, b, q, t) in zip(before, scored) if odds(q) + shift[a, b].quality_shift >= 0 and odds(t) + shift[a, b].toxic_shift < 0]
    assert same(after, want) and 0 < len(after) < len(before)
    words = {(r.text or "").split()[0][:4] for r in after if (r.text or "").split()}
    assert words == {"fine"}


def test_simhash_keeps_one_row_of_each_group(stages):
    before, after = stages[2]["simhash"]
    labels = brute_components([brute_fingerprint(r.text) for r in before])
    of = {}
    for r, label in zip(before, labels, strict=True):
        of.setdefault((label, r.doc_id is None), []).append(r)
    assert len(after) == len(of)
    for rows in of.values():
        kept = [r for r in after if r in rows]
        assert len(kept) == 1 and (kept[0].doc_id is None or kept[0].doc_id == min(r.doc_id for r in rows))


def test_decontamination_drops_contaminated_documents(stages):
    _, items, by = stages
    before, after = by["decontaminate"]
    want = [r for r in before if not brute_hits(r.text, items)[3]]
    assert same(after, want) and len(want) < len(before)


def test_secrets_are_replaced_and_counts_follow(stages):
    before, after = stages[2]["secrets"]
    want = []
    for r in before:
        text, kept = "", 0
        for kind, a, b in spans(r.text or "")[1]:
            if kind != "endpoint":
                text, kept = (text + r.text[kept:a] + "[REDACTED]", b) if a > kept or not kept else (text, max(kept, b))
        new = None if r.text is None else text + r.text[kept:]
        want.append({**r.asDict(), "text": new, "n_chars": r.n_chars if new is None else len(new)})
    assert same(after, [tuple(x.values()) for x in want])
    assert any("[REDACTED]" in (r.text or "") for r in after) and not any(KEY in (r.text or "") or BLOB in (r.text or "") for r in after)


def test_bpe_encodes_what_is_left(stages):
    before, after = stages[2]["bpe"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before:
        ids, raw = own.encode_ordinary(r.text or ""), (r.text or "").encode()
        want.append((r.doc_id, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert same([(r.doc_id, r.n_tokens, list(r.ids), r.ids_sha256, r.decoded_sha256) for r in after], want)


def test_run_is_the_stages_and_empty_tables_pass(spark, stages, tmp_path):
    folder, items, by = stages
    assert same(P.run(spark, folder).collect(), by["bpe"][1])
    write(spark, str(tmp_path), [], [], items[:0])
    got = P.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert all(spark.read.parquet(f"{folder}/{name}").columns == columns for name, _ in P.STAGES[:-1])
