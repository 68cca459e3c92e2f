"""Scores texts with a causal self-attention model over subword ids, trained in numpy on Spark's partitions.

A text is the ids of its words, each spelled with a space before it, and an end. One causal attention layer
over a window of WINDOW ids, by content and by distance, sums up what stands before a place. That sum and the last id
set the weights of MIX distributions over all ids and the end, whose mixture is the next id's probability: a
normalised one over single ids, for which no sum over the vocabulary has to be taken at each place. A word's
probability by its ids is that of its first id among those that begin words, times those of its other ids, times
that of the word ending there. Mixed with it, at SHARE, is the word's smoothed share of all training words, which
knows every word of the corpus; as in the base score, it takes all words that the corpus lacks for one more, so it
gives each of them that one's mass, and the score is a probability of texts in which unknown words are that one. A
text's score is the sum over its words of this and of the text going on, and of its ending.

Every training document is counted and trained on. A table of bounded size, gathered from all of them (which
frequent ids follow and accompany each other), starts the weights: ids in MIX groups by what goes with them.
Then each partition trains on its documents, AdaGrad for attention and weights and expectation maximisation for
the distributions, and Spark sums up the partitions' results in a tree, each row weighted by its use.

Texts are read once, in blocks of about BLOCK_CHARS characters of one partition: a block is a row of word
numbers, spellings, and counts, written as a table to the shared folder. Only blocks' words with their counts, and
the numbers for scoring, are shuffled, no text is. Scoring cuts ids into windows that overlap by CONTEXT; each id
is scored once, in the window where it has CONTEXT ids or all of its text before it. No table that grows with
the corpus is broadcast or collected: the model has a row for each id of the vocabulary.

Cases: a null text is the empty text (one token, the end). A null id counts as the empty string for
the fold. Repeated rows and null ids get a row each and count each. An empty table gives an empty
result; without training documents the counts are zero and the model is untrained. Texts and words of
any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from .common import release, shared_dir, slices, small_batches

#: Ids that the starting tables tell apart: the most frequent ones, and bins of the others.
HEAD, BINS = 256, 32
DIM, MIX = 16, 16
WINDOW, CONTEXT = 64, 24
STEP = WINDOW - CONTEXT
BLOCK_CHARS = 8 << 20
#: Passes over the training documents; windows a step; AdaGrad's rates of rows and of matrices.
ROUNDS, BATCH, RATE, SLOW = 1, 64, 0.3, 0.1
#: What the corpus' own word counts have in a word's probability, and how many ids the starting distributions count for.
SHARE, PRIOR = 0.6, 20_000.0
SMOOTH = 0.1
#: Results of so many partitions are summed up by one task.
FAN_IN = 32
FAR = -1e4


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' words, one text after the other, between ASCII white space and with A-Z in lower case, and how many each
    text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, n = parts.flatten(), pc.list_value_length(parts).to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0)  # empty ones stand for white space at the ends of a text
    n = np.bincount(np.repeat(np.arange(len(n)), n)[some.to_numpy(zero_copy_only=False)], minlength=len(n))
    return flat.filter(some), n


_encoders: dict[tuple, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(ranks: dict[bytes, int], pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the bytes of each id; one per Python worker and vocabulary."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _encoders:
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(token) for token in ranks]
        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[key]


def spelled(distinct: list[bytes], enc: tiktoken.Encoding, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each word after a space, one word after the other, and how many each has."""
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(distinct), 20_000):
        some = distinct[a : a + 20_000]
        flat = np.asarray(enc.encode_to_numpy((b" " + b" ".join(some)).decode(), disallowed_special=()), np.int64)
        past = np.cumsum(token_bytes[flat])
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        at = np.searchsorted(past, ends)
        if (past[np.minimum(at, len(past) - 1)] != ends).any():  # white space beyond ASCII has joined two words
            each = [enc.encode_ordinary(" " + w.decode()) for w in some]
            flat, at = np.fromiter(chain.from_iterable(each), np.int64), np.cumsum([len(x) for x in each]) - 1
        ids.append(flat)
        sizes.append(np.diff(at, prepend=-1))
    return np.concatenate(ids), np.concatenate(sizes)


CELLS = "cell long, n double"


def cells(counts: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some].astype(float))], names=["cell", "n"])


def gathered(counted: DataFrame, size: int) -> np.ndarray:
    """Sums by cell, of which there are size, whatever the data."""
    out = np.zeros(size)
    got = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def grouped(rows: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The group of each row, of at most k: nearest centres, found from far-apart rows on."""
    centres = [rows[int(weight.argmax())]]
    while len(centres) < k:
        away = np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0) * np.sqrt(weight)
        if away.max() <= 0:
            break
        centres.append(rows[int(away.argmax())])
    c = np.array(centres)
    for _ in range(30):
        who = ((rows[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for i in range(len(c)):
            if weight[who == i].sum() > 0:
                c[i] = np.average(rows[who == i], axis=0, weights=weight[who == i])
    return who


def associations(table: np.ndarray, size: int) -> np.ndarray:
    """Of each column's log association with the rows, the first dimensions, at unit length."""
    m = table + 0.5
    pmi = np.maximum(0, np.log(m / m.sum()) - np.log(np.outer(m.sum(axis=1), m.sum(axis=0)) / m.sum() ** 2))
    _, s, v = np.linalg.svd(pmi)
    got = np.zeros((table.shape[1], size))
    got[:, : len(s[:size])] = (np.sqrt(s[:size])[:, None] * v[:size]).T
    return got / np.maximum(1e-9, np.linalg.norm(got, axis=1, keepdims=True))


ROWS, DENSE = ("E", "A"), ("W", "Q", "K", "near")


class Attention:
    """P(next) = sum over z of g[z] * C[next, z] / sum(C[:, z]); g is the softmax of A[last] + c W, where c is the
    attention's average of E over the ids before."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @property
    def ids(self) -> int:
        """Ids and the end; the id before a text is one more."""
        return len(self.p["C"])

    @classmethod
    def start(cls, uses: np.ndarray, bucket: np.ndarray, follow: np.ndarray, together: np.ndarray) -> Attention:
        """uses of each id and the end; the bucket of each of those, and of the id before a text; how often a bucket
        follows another, and how often two stand in one stretch."""
        weight = np.bincount(bucket[: len(uses)], uses, len(follow))
        topic = associations(together, DIM)
        group = grouped(np.c_[topic, associations(follow, DIM)], weight + 1e-6, MIX)
        mine = np.eye(MIX)[group]
        share = (uses + 0.01) / (uses + 0.01).sum()
        c = PRIOR * share[:, None] * (0.9 * mine[bucket[: len(uses)]] + 0.1 / MIX)
        after = follow @ mine + 5 * (weight @ mine + 1) / (weight.sum() + MIX)
        a = np.log(after / after.sum(axis=1, keepdims=True))
        mean = (mine * (weight + 1e-6)[:, None]).T @ topic / ((mine * (weight + 1e-6)[:, None]).sum(axis=0)[:, None] + 1e-9)
        p = {"E": topic[bucket], "A": a[bucket], "C": c, "W": mean.T, "Q": np.eye(DIM) * 0.5, "K": np.eye(DIM) * 0.5, "near": np.zeros(WINDOW)}
        return cls({k: np.ascontiguousarray(v, dtype=np.float32) for k, v in p.items()})

    def near(self, context: int) -> np.ndarray:
        """What distance adds to the scores of a window's places, for those that ask; later places are out of reach."""
        far = distances(context)
        return np.where(far >= 0, self.p["near"][np.maximum(far, 0)], self.p["near"].dtype.type(FAR))

    def pairs(self) -> np.ndarray:
        """What a pair of rows of E, the one that asks first, is multiplied by for its score."""
        return self.p["Q"] @ self.p["K"].T * self.p["E"].dtype.type(DIM**-0.5)

    def forward(self, x: np.ndarray, real: np.ndarray, context: int = CONTEXT, asking: np.ndarray | None = None) -> tuple:
        """x: (windows, WINDOW) ids before each place; real: which of the places there are. Only those after the
        first context places ask. asking: E times pairs(), where the model no longer changes."""
        p = self.p
        kind = p["E"].dtype
        e, near = p["E"].take(x, axis=0), self.near(context)
        q = (e[:, context:].reshape(-1, DIM) @ self.pairs()).reshape(len(x), -1, DIM) if asking is None else asking.take(x[:, context:], axis=0)
        early = np.flatnonzero(~real[:, 0])  # windows with places before their text; places after it are out of reach
        c, total, weights = np.empty_like(q), np.empty((*q.shape[:2], 1), kind), []
        for asks, upto in panels(context):
            s = q[:, asks] @ e[:, :upto].transpose(0, 2, 1)
            large = s.max(initial=0) + near.max() > 30
            s += near[asks, :upto]
            if large:
                np.minimum(s, kind.type(30), out=s)
            np.exp(s, out=s)
            if len(early):
                s[early] *= real[early, None, :upto]
            total[:, asks] = (s.reshape(-1, upto) @ np.ones(upto, kind)).reshape(len(x), -1, 1)
            np.matmul(s, e[:, :upto], out=c[:, asks])
            weights.append(s)
        total, c = total.reshape(-1, 1) + kind.type(1e-30), c.reshape(-1, DIM)
        c /= total
        g = p["A"].take(x[:, context:].ravel(), axis=0)
        g += c @ p["W"]
        np.clip(g, -40, 40, out=g)
        np.exp(g, out=g)
        g /= g @ np.ones((MIX, 1), kind)
        return e, q, weights, total, c, g

    def shares(self, y: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        return self.p["C"].take(y, axis=0) * (1 / (self.p["C"].sum(axis=0) if sums is None else sums))

    def probabilities(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, among: np.ndarray, sums: np.ndarray, asking: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each target y its probability, and those of sets of ids, whose shares are the columns of among."""
        g = self.forward(x, real, WINDOW - y.shape[1], asking)[-1]
        sets = (g @ among).reshape(*y.shape, -1)
        g *= self.shares(y.ravel(), sums)
        return (g @ np.ones(MIX, g.dtype)).reshape(y.shape), sets

    def gradient(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, sums: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the targets' summed log likelihood: for E a row per place of the windows, for A one per place that
        asks, and the targets' posteriors over the distributions."""
        p, context = self.p, WINDOW - y.shape[1]
        e, q, weights, total, c, g = self.forward(x, real, context)
        kind, ones = g.dtype, np.ones((MIX, 1), g.dtype)
        post = self.shares(y.ravel(), sums)
        post *= g
        post /= post @ ones + kind.type(1e-30)
        if not real.all():
            some = real[:, context:].reshape(-1, 1)
            post *= some
            g *= some
        d = post - g
        out = {"A": d, "W": c.T @ d}
        dc = d @ p["W"].T
        dc /= total
        c *= dc
        own = (c @ np.ones((DIM, 1), kind)).reshape(len(x), -1, 1)
        dc = dc.reshape(q.shape)
        de, u, near = np.zeros_like(e), np.empty_like(q), np.zeros((WINDOW - context, WINDOW))
        for (asks, upto), s in zip(panels(context), weights, strict=True):
            t = dc[:, asks] @ e[:, :upto].transpose(0, 2, 1)
            t -= own[:, asks]  # what the average takes from each of its parts
            t *= s
            near[asks, :upto] = t.sum(axis=0)
            np.matmul(t, e[:, :upto], out=u[:, asks])
            de[:, :upto] += s.transpose(0, 2, 1) @ dc[:, asks]
            de[:, :upto] += t.transpose(0, 2, 1) @ q[:, asks]
        out["near"] = np.bincount(np.maximum(distances(context), 0).ravel(), near.ravel(), WINDOW)
        scale, u = kind.type(DIM**-0.5), u.reshape(-1, DIM)
        pairs = e[:, context:].reshape(-1, DIM).T @ u * scale
        out["Q"], out["K"] = pairs @ p["K"], pairs.T @ p["Q"]
        de[:, context:] += (u @ self.pairs().T).reshape(q.shape)
        out["E"] = de.reshape(-1, DIM)
        return out, post


def distances(context: int) -> np.ndarray:
    """How far each place of a window is before each of those that ask."""
    return np.arange(context, WINDOW)[:, None] - np.arange(WINDOW)[None, :]


def panels(context: int) -> list[tuple[slice, int]]:
    """The places that ask, each part with the number of places that its last one reaches. Where all places ask, those of
    the first half have no scores for the second."""
    n = WINDOW - context
    return [(slice(a, b), context + b) for a, b in (((0, n),) if context else ((0, n // 2), (n // 2, n)))]


def by_row(rows: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows and their sums of each of values."""
    order = np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")
    rows = rows.take(order)
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    two = lambda v: np.ascontiguousarray(v, np.float32).view(np.complex64).take(order, axis=0)  # noqa: E731  # sums of numbers in twos
    return rows.take(firsts), *(np.add.reduceat(two(v), firsts).view(np.float32) for v in values)


class Training:
    """A partition's own copy of the model, and what it adds up to."""

    def __init__(self, model: Attention):
        p = {k: v.copy() for k, v in model.p.items()}
        self.model, self.begin = Attention(p), model.p["C"]
        self.squares = {k: np.full(p[k].shape, 1e-6, np.float32) for k in (*ROWS, *DENSE)}
        self.used = {k: np.zeros(len(p[k])) for k in ROWS}
        self.seen, self.sums = 0, p["C"].sum(axis=0)

    def step(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> None:
        p, n = self.model.p, max(1, int(real[:, WINDOW - y.shape[1] :].sum()))
        g, post = self.model.gradient(x, real, y, self.sums)
        some, *totals = by_row(x.ravel(), g["E"], g["A"])  # every place asks
        for k, total in zip(ROWS, totals, strict=True):
            self.climb(k, some, total * np.float32(1 / n), RATE)
            self.used[k][some] += 1
        for k in DENSE:
            self.climb(k, slice(None), (g[k] / n).astype(np.float32), SLOW)
        some, total = by_row(y.ravel(), post)
        p["C"][some] += total
        self.sums = self.sums + total.sum(axis=0)
        self.seen += n

    def climb(self, k: str, rows: np.ndarray | slice, g: np.ndarray, rate: float) -> None:
        of = lambda table: table[rows] if isinstance(rows, slice) else table.take(rows, axis=0)
        now = of(self.squares[k]) + g * g
        self.squares[k][rows] = now
        g = g * np.float32(rate)
        g /= np.sqrt(now)
        g += of(self.model.p[k])
        self.model.p[k][rows] = g

    def run(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Windows side by side, in which every place asks."""
        text, start = starts(sizes, WINDOW)
        order, firsts = np.random.default_rng(len(text)).permutation(len(text)), np.cumsum(sizes) - sizes
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            self.step(*window(flat, sizes, text[some], start[some], self.model.ids, firsts, 0)[:3])


class Sums:
    """Partitions' models as sums: rows times their use, matrices times the ids seen, added counts."""

    def __init__(self, model: Attention):
        shapes = {k: v.shape for k, v in model.p.items()}
        self.total = {k: np.zeros(shapes[k]) for k in shapes}
        self.used = {k: np.zeros(shapes[k][0]) for k in ROWS}
        self.seen = 0

    def of(self, t: Training) -> Sums:
        p = t.model.p
        for k in ROWS:
            self.total[k], self.used[k] = p[k] * t.used[k][:, None], t.used[k]
        for k in DENSE:
            self.total[k] = p[k].astype(np.float64) * t.seen
        self.total["C"], self.seen = p["C"] - t.begin, t.seen
        return self

    def rows(self) -> pa.RecordBatch:
        """Rows that nothing has used stay out."""
        out = [(k, -1, 0.0, self.total[k].tobytes()) for k in DENSE] + [("seen", -1, float(self.seen), b"")]
        for k in (*ROWS, "C"):
            used = self.used[k] if k in ROWS else np.abs(self.total[k]).sum(axis=1)
            some = np.flatnonzero(used)
            out += [(k, len(some), 0.0, some.astype("<i8").tobytes() + used[some].astype("<f8").tobytes() + self.total[k][some].astype("<f4").tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.float64(), pa.binary()))], names=["name", "n", "x", "data"])

    def add(self, batch: pa.RecordBatch | pa.Table) -> None:
        for k, n, x, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k == "seen":
                self.seen += x
            elif not n:
                continue
            elif n < 0:
                self.total[k] += np.frombuffer(data).reshape(self.total[k].shape)
            else:
                some = np.frombuffer(data, "<i8", n)
                if k in ROWS:
                    self.used[k][some] += np.frombuffer(data, "<f8", n, 8 * n)
                self.total[k][some] += np.frombuffer(data, "<f4", offset=16 * n).reshape(n, -1)

    def model(self, before: Attention) -> Attention:
        p = {k: before.p[k].copy() for k in before.p}
        for k in ROWS:
            some = np.flatnonzero(self.used[k])
            p[k][some] = self.total[k][some] / self.used[k][some, None]
        for k in DENSE if self.seen else ():
            p[k] = (self.total[k] / self.seen).astype(np.float32)
        p["C"] = (p["C"] + self.total["C"]).astype(np.float32)
        return Attention(p)


SUMS = "name string, n long, x double, data binary"


def starts(sizes: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Of each window its text and the place in it where it begins to ask."""
    n = -(-sizes // step)
    return np.repeat(np.arange(len(sizes)), n), (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step


def window(
    flat: np.ndarray, sizes: np.ndarray, text: np.ndarray, start: np.ndarray, before: int, firsts: np.ndarray, context: int = CONTEXT
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some windows over texts' ids, one text after the other: the id before each place, which places there
    are, the targets of the places that ask, and those targets' places in flat (-1: none)."""
    t = start[:, None] + np.arange(-context, WINDOW - context)[None, :]
    real = (t >= 0) & (t < sizes[text][:, None])
    at = t + firsts[text][:, None]
    x = flat.take(at - 1, mode="clip").astype(np.int64)
    np.copyto(x, before, where=~real | (t == 0))
    at = at[:, context:]
    return x, real, flat.take(at, mode="clip").astype(np.int64), np.where(real[:, context:], at, -1)


def windows(flat: np.ndarray, sizes: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return window(flat, sizes, *starts(sizes), before, np.cumsum(sizes) - sizes)


class Block:
    """Texts as word numbers, words as ids, from a row of the table of blocks."""

    def __init__(self, row: dict, end: int):
        self.end = end
        self.sizes, self.numbers = np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["numbers"], "<u4").astype(np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.word_sizes = np.append(np.frombuffer(row["word_sizes"], "<u4").astype(np.int64), 1)  # the end is one more word
        self.word_ids = np.append(np.frombuffer(row["word_ids"], "<u4").astype(np.int32), np.int32(end))

    def sequence(self, training: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts or those for training: ids, ids of each text, words (with the ends) and where each begins."""
        numbers, sizes = self.numbers, self.sizes
        if training:
            numbers, sizes = numbers[np.repeat(~self.held, sizes)], sizes[~self.held]
        numbers = np.insert(numbers, np.cumsum(sizes), len(self.word_sizes) - 1)
        n = self.word_sizes[numbers]
        begins = np.cumsum(n) - n
        first = np.cumsum(self.word_sizes) - self.word_sizes
        at = np.repeat(first[numbers] - begins, n)
        at += np.arange(len(at))
        flat = self.word_ids.take(at)
        of_text = np.add.reduceat(n, np.cumsum(sizes + 1) - sizes - 1) if len(sizes) else sizes
        return flat, of_text, numbers, begins


def uses_of(counts: np.ndarray, word_ids: np.ndarray, word_sizes: np.ndarray, end: int) -> np.ndarray:
    """How often each id comes in words that come so often."""
    return np.bincount(word_ids, np.repeat(counts, word_sizes), end + 1)


def score(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    held_out: Column | None = None, block_chars: int = BLOCK_CHARS, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4()}"
    id_type = docs.schema[id_col].dataType
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0 if held_out is None else held_out
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(fold, F.lit(False)).alias("held_out"))
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary file
    end = max(ranks.values(), default=0) + 1

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, token_bytes = encoder(shared.value, pattern)
        texts: list[tuple[pa.Array, np.ndarray]] = []
        ids: list[pa.Array] = []
        held: list[bool] = []
        chars = nth = 0

        def block() -> pa.RecordBatch:
            sizes = np.concatenate([n for _, n in texts])
            each = pa.concat_arrays([some for some, _ in texts]).dictionary_encode()
            numbers, distinct = each.indices.to_numpy(), each.dictionary
            # frequent words have small numbers, which take less room
            order = np.argsort(-np.bincount(numbers, minlength=len(distinct)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            numbers, distinct = place[numbers], distinct.take(pa.array(order)).cast(pa.binary())
            n = np.bincount(numbers[np.repeat(~np.array(held, bool), sizes)], minlength=len(distinct))
            word_ids, word_sizes = spelled(distinct.to_numpy(zero_copy_only=False).tolist(), enc, token_bytes)
            key = (TaskContext.get().partitionId() << 32) + nth
            small = lambda a: pa.array([a.astype("<u4").tobytes()], pa.binary())
            columns = [
                pa.array([key]), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids)), pa.array([np.array(held, np.uint8).tobytes()], pa.binary()),
                small(sizes), small(numbers), pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), pa.array([n], pa.list_(pa.int64())), small(word_ids), small(word_sizes),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "held", "sizes", "numbers", "words", "counts", "word_ids", "word_sizes"])

        for part in slices(batches):
            texts.append(words(part.column(1)))
            ids.append(part.column(0))
            held += part.column(2).to_pylist()
            chars += part.column(1).nbytes
            if chars >= block_chars:
                yield block()
                texts, ids, held, chars, nth = [], [], [], 0, nth + 1
        if texts:
            yield block()
        release()

    schema = f"block long, doc_ids {ArrayType(id_type).simpleString()}, held binary, sizes binary, numbers binary, words array<binary>, counts array<long>, word_ids binary, word_sizes binary"
    rows.mapInArrow(to_blocks, schema).write.option("compression", "zstd").parquet(folder)
    blocks = small_batches(spark.read.schema(schema).parquet(folder))

    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    # a row a block and word, dealt by word once; a word has a row a block at most
    of_word = Window.partitionBy("word").orderBy("block")
    whole = of_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # of the same order, so both are found in one go
    first = F.row_number().over(of_word) == 1
    known = each.select(F.col("block").alias("of_block"), "place", "n", F.sum("n").over(whole).alias("c"), first.alias("first")).where("c > 0")
    known.write.option("compression", "zstd").parquet(f"{folder}-known")
    known = spark.read.schema(known.schema).parquet(f"{folder}-known")
    in_words, distinct_words = known.agg(F.sum("n"), F.count_if("first")).first()
    ids_of = blocks.select("held", "sizes", "numbers", "word_ids", "word_sizes")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                flat, of_text, *_ = Block(batch.slice(i, 1).to_pylist()[0], end).sequence(training=True)
                if len(flat):
                    yield flat, of_text

    def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1)
        release()
        for batch in batches:
            for held, counts, word_ids, word_sizes in zip(*batch.columns, strict=True):
                total += uses_of(counts.values.to_numpy(), *(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in (word_ids, word_sizes)), end)
                total[end] += held.as_py().count(0)
        yield cells(total)

    uses = gathered(blocks.select("held", "counts", "word_ids", "word_sizes").mapInArrow(count_ids, CELLS), end + 1)  # a row an id
    n_train = int(uses[end])
    n, v = (in_words or 0) + n_train, distinct_words + (n_train > 0)  # with the ends
    order = np.argsort(-uses, kind="stable")
    bucket = np.empty(end + 2, np.int64)
    bucket[order[:HEAD]] = np.arange(min(HEAD, len(order)))
    mass = np.cumsum(uses[order[HEAD:]] + SMOOTH)  # bins of about equal weight
    bucket[order[HEAD:]] = HEAD + np.minimum((mass / max(mass[-1:].sum(), SMOOTH) * BINS).astype(int), BINS - 1)
    bucket[end + 1] = size = HEAD + BINS  # what stands before a text
    size += 1

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow, together = np.zeros(size * size), np.zeros((size, size))
        for flat, of_text in sequences(batches):
            mine, firsts = bucket[flat], np.cumsum(of_text) - of_text
            last = np.r_[size - 1, mine[:-1]]
            last[firsts] = size - 1
            follow += np.bincount(last * size + mine, minlength=size * size)
            n_of = -(-of_text // STEP)
            stretch = np.repeat(np.cumsum(n_of) - n_of, of_text) + (np.arange(len(flat)) - np.repeat(firsts, of_text)) // STEP
            for a in range(0, int(n_of.sum()), 1024):  # stretches of one text, their histograms multiplied
                i = np.searchsorted(stretch, [a, a + 1024])
                h = np.bincount((stretch[i[0] : i[1]] - a) * size + mine[i[0] : i[1]], minlength=1024 * size).reshape(1024, size).astype(np.float32)
                together += h.T @ h - np.diag(h.sum(axis=0))
        yield cells(np.r_[follow, together.ravel()])

    pairs = gathered(ids_of.mapInArrow(count_pairs, CELLS), 2 * size * size).reshape(2, size, size)  # a row a pair of buckets
    model = Attention.start(uses, bucket, *pairs)

    def train(given: Attention):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Training(given)
            for flat, of_text in sequences(batches):
                mine.run(flat, of_text)
            yield Sums(given).of(mine).rows()

        return run

    def summed(given: Attention):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = Sums(given)
            for batch in batches:
                total.add(batch)
            yield total.rows()

        return run

    for _ in range(rounds):
        local = ids_of.mapInArrow(train(model), SUMS).checkpoint()
        while (parts := local.rdd.getNumPartitions()) > 1:
            local = local.coalesce(ceil(parts / FAN_IN)).mapInArrow(summed(model), SUMS).checkpoint()
        total = Sums(model)
        total.add(local.toArrow())  # one model
        model = total.model(model)

    sums = model.p["C"].sum(axis=0)
    begins = np.zeros(end + 1)  # ids that begin a word
    begins[[i for token, i in ranks.items() if token[:1] == b" "]] = 1
    among = np.stack([begins @ (model.p["C"] / sums), model.p["C"][end] / sums], axis=1).astype(np.float32)
    trained = spark.sparkContext.broadcast((model, sums, among))  # a row an id
    out_schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [c.split()[0] for c in out_schema.split(", ")]

    def score_block(table: pa.Table, known: pa.Table) -> pa.Table:
        model, sums, among = trained.value
        parts, asking = [], model.p["E"] @ model.pairs()
        for row in range(table.num_rows):
            block = Block(table.select(["held", "sizes", "numbers", "word_ids", "word_sizes"]).slice(row, 1).to_pylist()[0], end)
            c = np.zeros(len(block.word_sizes))
            c[known["place"].to_numpy()] = known["c"].to_numpy()
            c[-1] = n_train
            share = (c + SMOOTH) / (n + SMOOTH * (v + 1))
            base = np.log10(share)
            flat, of_text, numbers, at = block.sequence()
            p, masses = np.zeros(len(flat), np.float32), np.zeros((len(flat), 2), np.float32)
            text, start = starts(of_text)
            firsts = np.cumsum(of_text) - of_text
            for a in range(0, len(text), BATCH):
                x, real, y, places = window(flat, of_text, text[a : a + BATCH], start[a : a + BATCH], end + 1, firsts)
                got, sets = model.probabilities(x, real, y, among, sums, asking)
                asked = real[:, CONTEXT:]
                places = places[asked]
                p[places], masses[places] = got[asked], sets[asked]
            log_p, masses = np.log(np.maximum(p, 1e-30, dtype=np.float64)), masses.take(at, axis=0).astype(np.float64)
            goes_on, stops = (np.log(np.maximum(x, 1e-30)) for x in masses.T)
            either = np.log(np.maximum(masses.sum(axis=1), 1e-30))
            is_end = numbers == len(block.word_sizes) - 1
            # by its ids: the first among those that begin words, the others, and that the word ends where the next begins
            by_ids = np.add.reduceat(log_p, at) - goes_on + np.append(either[1:], 0)
            mixed = np.log((SHARE * share).take(numbers) + (1 - SHARE) * np.exp(np.maximum(by_ids, -690)))
            each = (np.where(is_end, stops, goes_on + mixed) - either) / np.log(10)
            tokens = np.cumsum(block.sizes + 1) - block.sizes - 1
            parts.append(pa.table(
                [table["doc_ids"].slice(row, 1).combine_chunks().flatten(), pa.array(block.held), pa.array(block.sizes + 1), pa.array(np.add.reduceat((c > 0)[numbers].astype(np.int64), tokens)),
                 pa.array([n] * len(tokens), pa.int64()), pa.array(np.add.reduceat(base[numbers], tokens)), pa.array(np.add.reduceat(each, tokens))],
                names=names,
            ))
        release()
        return pa.concat_tables(parts)

    found = known.select("of_block", "place", "c")
    return blocks.drop("words", "counts").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(score_block, out_schema)
