import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.llm import bpe, lm

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    tongues = [["".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(300)] for s in (["th", "er", "on", "a"], ["qu", "eau", "é", "les"], ["sch", "ung", "ü", "ei"])]
    weights = [1 / (i + 1) for i in range(300)]
    made = [" ".join(rng.choices(rng.choice(tongues), weights, k=rng.randint(0, 150))) for _ in range(500)]
    return [*made, None, "", "One two ONE\ttwo x", "long " * 3000, "x" * 3000]


@pytest.fixture(scope="module")
def found(spark, texts):
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "no id", "z"), (3, texts[3], "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return rows, lm.score(d, RANKS, public_tokenizers.PATTERN, block_chars=20_000).collect()


def test_counts_and_base_are_brute_force(found):
    rows, got = found
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter()
    for i, t, _ in rows:
        if not fold(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((str(i), fold(i), len(tokens), sum(x in c for x in tokens), n, sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_held_out_texts_are_likelier_than_by_the_base(found):
    """All of them, with their unknown words."""
    held = [r for r in found[1] if r.held_out]
    assert all(np.isfinite(r.score) and r.score < 0 for r in found[1])
    assert any(r.n_known < r.n_tokens for r in held)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_documents_are_likelier_than_by_the_base(spark, sf):
    got = lm.score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), RANKS, public_tokenizers.PATTERN)
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.sum("n_known")).first()
    assert held[0] > held[1] and held[3] < held[2]


def test_windows_score_each_id_once_with_what_is_before_it():
    sizes = np.array([1, 39, 40, 41, 200, 3])
    flat, before = np.arange(sizes.sum()) % 200, 999
    x, mask, y, places = lm.windows(flat, sizes, before)
    assert sorted(places[places >= 0]) == list(range(sizes.sum()))
    assert (y[places >= 0] == flat[places[places >= 0]]).all()
    begins = set(np.cumsum(sizes) - sizes)
    for w, p in zip(*np.nonzero(places >= 0), strict=True):
        at = places[w, p]
        assert x[w, lm.CONTEXT + p] == (before if at in begins else flat[at - 1])


def model_of(ids, seed=0):
    rng = np.random.default_rng(seed)
    size = 12
    bucket = np.r_[rng.integers(0, size - 1, ids), size - 1]
    return lm.Attention.start(rng.integers(0, 50, ids).astype(float), bucket, *rng.integers(0, 50, (2, size, size)).astype(float)), rng


def test_attention_is_causal_normalised_over_ids_and_its_gradient_is_right():
    ids = 90
    model, rng = model_of(ids)
    flat, sizes = rng.integers(0, ids, 90), np.array([70, 20])
    x, mask, y, _ = lm.windows(flat, sizes, ids)
    sums = model.p["C"].sum(axis=0)
    among = np.eye(ids)[:, :2].T @ (model.p["C"] / sums)
    p_of = lambda x, y: model.probabilities(x, mask, y, among.T, sums)
    assert np.allclose(sum(p_of(x, np.full_like(y, k))[0] for k in range(ids)), 1, atol=1e-3)
    assert np.allclose(p_of(x, np.ones_like(y))[0], p_of(x, y)[1][:, :, 1], atol=1e-5)
    changed = x.copy()
    changed[:, lm.CONTEXT + 20 :] = 5
    assert np.allclose(p_of(x, y)[0][:, :20], p_of(changed, y)[0][:, :20], atol=1e-6)
    for context in (0, lm.CONTEXT):
        x, mask, y, _ = lm.window(flat, sizes, *lm.starts(sizes, lm.WINDOW - context), ids, np.cumsum(sizes) - sizes, context)
        real = mask[:, context:]
        model = lm.Attention({k: v.astype(np.float64) for k, v in model_of(ids)[0].p.items()})
        g, post = model.gradient(x, mask, y)
        assert np.allclose(post.sum(axis=1).reshape(real.shape)[real], 1)
        rows = {"E": x.ravel(), "A": x[:, context:].ravel()}
        for k, some in rows.items():
            total = np.zeros((ids + 1, lm.DIM))
            np.add.at(total, some, g[k])
            g[k] = total

        def gain(m):
            return np.log(m.probabilities(x, mask, y, among.T, m.p["C"].sum(axis=0))[0])[real].sum()

        for k in (*lm.ROWS, *lm.DENSE):
            at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
            up, down = ({**model.p, k: model.p[k].copy()} for _ in range(2))
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            assert g[k][at] == pytest.approx((gain(lm.Attention(up)) - gain(lm.Attention(down))) / 2e-4, rel=1e-2, abs=1e-4), (k, context)


@pytest.mark.parametrize("context", [0, lm.CONTEXT])
def test_attention_is_that_of_each_place_alone_and_holds_no_scores_out_of_reach(context):
    ids = 90
    model, rng = model_of(ids, 2)
    model.p["near"][:] = rng.normal(0, 1, lm.WINDOW)
    for large in (1, 40):  # beyond 1, some scores are cut at 30
        p = {k: v.astype(float) for k, v in model.p.items()}
        p["E"] = p["E"] * large
        flat, sizes = rng.integers(0, ids, 300), np.array([70, 1, 0, 129, 100])
        x, real, *_ = lm.window(flat, sizes, *lm.starts(sizes, lm.WINDOW - context), ids, np.cumsum(sizes) - sizes, context)
        *_, weights, _, c, g = lm.Attention(p).forward(x, real, context)
        assert np.allclose(g, lm.Attention(p).forward(x, real, context, p["E"] @ lm.Attention(p).pairs())[-1])
        c, g = c.reshape(len(x), -1, lm.DIM), g.reshape(len(x), -1, lm.MIX)
        for w, i in zip(*np.nonzero(real[:, context:]), strict=True):
            at = [j for j in range(context + i + 1) if real[w, j]]
            e = p["E"][x[w]]
            scores = [e[context + i] @ p["Q"] @ (e[j] @ p["K"]) / lm.DIM**0.5 + p["near"][context + i - j] for j in at]
            much = np.exp(np.minimum(scores, 30))
            assert c[w, i] == pytest.approx(much @ e[at] / much.sum(), rel=1e-6, abs=1e-9)
            mix = np.exp(np.clip(p["A"][x[w, context + i]] + c[w, i] @ p["W"], -40, 40))
            assert g[w, i] == pytest.approx(mix / mix.sum(), rel=1e-6, abs=1e-12)
    assert sum(s.size for s in weights) <= (0.75 if not context else 1) * len(x) * (lm.WINDOW - context) * lm.WINDOW


def test_words_are_those_of_the_texts_bytes():
    texts = ["", "  ", "One two ONE\ttwo x ", "\x0b\x0ca\r\n b\x1cc", "É\xa0é\u2003Z ÀB", "x" * 3000, " y"]
    for some in (texts, texts[:2], []):
        got, n = lm.words(pa.array(some, pa.string()))
        assert got.cast(pa.binary()).to_pylist() == [w for t in some for w in t.encode().lower().split()]
        assert n.tolist() == [len(t.encode().lower().split()) for t in some]
    got, n = lm.words(pa.array(texts).slice(2, 3))
    assert n.tolist() == [5, 2, 2] and len(got) == 9


def test_training_raises_the_likelihood_and_partitions_add_up():
    ids = 60
    model, rng = model_of(ids, 1)
    flat, sizes = np.tile(rng.permutation(ids), 200).astype(np.int32), np.full(60, 200)
    x, mask, y, _ = lm.windows(flat, sizes, ids)
    mean = lambda m: np.log(m.probabilities(x, mask, y, np.zeros((lm.MIX, 1), np.float32), m.p["C"].sum(axis=0))[0])[mask[:, lm.CONTEXT :]].mean()
    halves = []
    for part in range(2):
        mine = lm.Training(model)
        mine.run(flat[part * 6000 : (part + 1) * 6000], sizes[:30])
        assert mine.seen == 6000
        halves.append(lm.Sums(model).of(mine).rows())
    total = lm.Sums(model)
    for half in halves:
        again = lm.Sums(model)
        again.add(half)
        total.add(again.rows())
    both = total.model(model)
    assert total.seen == 12_000 and mean(both) > mean(model) + 0.1
    assert both.p["C"].sum() == pytest.approx(model.p["C"].sum() + 12_000, rel=1e-3)
    assert lm.DIM >= 16 and lm.WINDOW >= 64 and lm.CONTEXT >= 24


def test_blocks_hold_every_text_and_training_takes_all_that_are_not_held_out():
    small = lambda x: np.array(x, "<u4").tobytes()
    row = {"sizes": small([2, 0, 3, 1]), "numbers": small([0, 1, 2, 2, 0, 1]), "held": np.array([0, 0, 1, 0], np.uint8).tobytes(), "word_sizes": small([1, 3, 2]), "word_ids": small([7, 4, 5, 6, 8, 9])}
    block = lm.Block(row, 99)
    flat, of_text, numbers, begins = block.sequence()
    assert flat.tolist() == [7, 4, 5, 6, 99, 99, 8, 9, 8, 9, 7, 99, 4, 5, 6, 99] and of_text.tolist() == [5, 1, 6, 4]
    assert numbers.tolist() == [0, 1, 3, 3, 2, 2, 0, 3, 1, 3] and begins.tolist() == [0, 1, 4, 5, 6, 8, 10, 11, 12, 15]
    assert block.sequence(training=True)[0].tolist() == [7, 4, 5, 6, 99, 99, 4, 5, 6, 99]
    uses = lm.uses_of(np.array([1, 2, 0]), block.word_ids[:-1], block.word_sizes[:-1], 99)
    assert uses[:99].tolist() == np.bincount(block.sequence(training=True)[0], minlength=100)[:99].tolist()


def test_spelling_is_that_of_each_word_alone():
    enc, token_bytes = lm.encoder(RANKS, public_tokenizers.PATTERN)
    some = [w.encode() for w in ["the", "ththtionre.", "\xa0x", "y\xa0", "\xa0", "\u2003\u2003", "éèê", "1234,5", "日本語テキスト", "a" * 500]]
    for part in (some, some[:2] + some[6:]):
        ids, sizes = lm.spelled(part, enc, token_bytes)
        assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [enc.encode_ordinary(" " + w.decode()) for w in part]


def test_encoders_are_told_apart_by_content():
    other = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert len(other) == len(RANKS)
    text = " éèê ththtionre"
    first, second = (lm.encoder(r, public_tokenizers.PATTERN)[0].encode_ordinary(text) for r in (RANKS, other))
    assert first != second and second == lm.encoder(other, public_tokenizers.PATTERN)[0].encode_ordinary(text)


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).count() == 0
