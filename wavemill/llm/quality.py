"""Quality classification: document evidence with hierarchical empirical Bayes over sites.

A logistic classifier over hashed word, prefix and word-shape features is fitted in numpy on a bounded
sample of labelled documents (SAMPLE rows, those of least hash). It scores every document. Grouped sums
of the scores over all documents give each site (host, and path within host) its share of good
documents; a host is shrunk towards the global share and a path towards its host by prior strengths
that the spread between hosts and between paths implies (method of moments), so sparse sites say little.
A document's posterior odds are its own odds times its path's odds over the global odds. The same is
done for toxicity; documents are kept if quality is at least, and toxicity below, one half.

Only per-site sums are shuffled, pre-aggregated before, and up to MOST_SITES sites are broadcast. Beyond that,
short rows (a document's key and scores) meet the sites' table, rows of a hot site spread over several tasks, and
the keys of rejected documents are taken out of the documents; texts are not shuffled by site. The driver holds the
sample's features and a few global sums.

Cases: a null text is the empty text, scored by the intercept. Null hosts or paths form a site of their
own. Null labels take no part; without labels of both kinds, a head knows no evidence and its odds are
even for quality, and nothing is toxic. Repeated rows and null ids get a row each, repeated labelled rows count
once. Texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, shared_dir, slices, small_batches

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 12_000
#: Features of a sampled document that go to the driver, at most: of longer ones the words of least hash; scoring reads whole texts.
MOST_FEATURES = 60_000
FEATURES, EPOCHS, BATCH, RATE, RIDGE = 1 << 17, 12, 128, 1.0, 1e-6
#: A document's log odds are sums over its distinct words, divided by this.
SCALE = 8.0
REMEMBERED = 100_000
MOST_SITES = 100_000
HEADS = ("quality", "toxic")
EDGES = re.compile(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*(.*?)([\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*)$", re.S)


def features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself in lower case, its first letters, and its shape (case and what follows it)."""
    core, after = EDGES.match(word).groups()
    low = core.lower()
    shape = b"U" if len(core) > 1 and core == core.upper() and core != low else b"u" if core[:1].isupper() else b"l" if core else b"-"
    return tuple(zlib.crc32(x) % FEATURES for x in (b"w" + low, b"p" + low[:5], b"s" + shape + after[:3]))


def repetition(n: int, distinct: int) -> tuple[int, ...]:
    """Hashed features of how often a text's words repeat."""
    return tuple(zlib.crc32(x) % FEATURES for x in (b"r%d" % (10 * distinct // max(n, 1)), b"n%d" % n.bit_length(), b"b%d:%d" % (5 * distinct // max(n, 1), n.bit_length() // 2)))


def of_text(text: bytes, most: int = MOST_FEATURES) -> list[int]:
    """The features of the distinct words, by hash those of most features in all, and of how often words repeat."""
    words = text.split()
    distinct, room = sorted(set(words)), (most - 3 * int(SCALE)) // 3
    count = len(distinct)
    if count > room:
        distinct = sorted(sorted(distinct, key=lambda word: hashlib.md5(word).digest())[:room])
    return [x for word in distinct for x in features(word)] + [x for x in repetition(len(words), count) for _ in range(int(SCALE))]


class Classifier:
    """Two logistic heads over the features of a text's distinct words."""

    def __init__(self, weights: np.ndarray, intercepts: np.ndarray):
        self.weights, self.intercepts = weights, intercepts

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Classifier:
        """rows: features of each document; labels: 1, 0 or NaN (unknown), a column per head. AdaGrad on log loss."""
        rng, heads = np.random.default_rng(seed), labels.shape[1]
        weights, intercepts = np.zeros((heads, FEATURES), np.float32), np.zeros(heads)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat, ends = np.concatenate([np.zeros(0, np.int32), *rows]), np.cumsum(sizes)
        for head in range(heads):
            y = labels[:, head]
            known = np.flatnonzero(~np.isnan(y))
            if not len(known) or y[known].min() == y[known].max():
                intercepts[head] = 0.0 if head == 0 else -20.0
                continue
            w, seen, b, b_seen = weights[head], np.full(FEATURES, 1e-6, np.float32), np.log(y[known].mean() / (1 - y[known].mean())), 1e-6
            for _ in range(EPOCHS):
                for some in np.array_split(rng.permutation(known), max(1, len(known) // BATCH)):
                    index = np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in some])
                    row = np.repeat(np.arange(len(some)), sizes[some])
                    z = b + np.bincount(row, w[index], len(some)) / SCALE
                    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
                    step = (np.bincount(index, error[row] / SCALE, FEATURES) + RIDGE * w).astype(np.float32)
                    seen += step**2
                    w -= RATE * step / np.sqrt(seen)
                    b_seen += error.sum() ** 2
                    b -= RATE * error.sum() / np.sqrt(b_seen)
            intercepts[head] = b
        return cls(weights, intercepts)


class Scorer(dict):
    """word -> both heads' weights, as the parts of one complex number; words are remembered up to a bound."""

    def __init__(self, classifier: Classifier):
        super().__init__()
        self.intercepts = classifier.intercepts
        self.weights = (classifier.weights[0] + 1j * classifier.weights[1]).tolist()

    def __missing__(self, word: bytes) -> complex:
        if len(self) >= REMEMBERED:
            self.clear()
        a, b, c = features(word)
        self[word] = both = self.weights[a] + self.weights[b] + self.weights[c]
        return both

    def __call__(self, text: bytes) -> tuple[float, float]:
        words = text.split()
        distinct = set(words)
        total = sum(map(self.__getitem__, distinct), 0j) / SCALE + sum(map(self.weights.__getitem__, repetition(len(words), len(distinct))))
        z = np.clip([total.real, total.imag] + self.intercepts, -30, 30)
        return tuple(1 / (1 + np.exp(-z)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fits on at most sample labelled documents, those whose id has the least hash."""
    known = labels.where("quality is not null or toxic is not null").select(F.col(id_col).alias("id"), *HEADS)
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id", *HEADS).limit(sample))  # bounded by sample
    thin = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(known, "id")
    # documents that share an id do not raise the bound: the rows of least hash stay, before anything goes to the driver
    row = F.xxhash64("id", "text", *HEADS)
    least = thin.select(row.alias("row")).distinct().orderBy("row").limit(sample)
    thin = thin.withColumn("row", row).join(F.broadcast(least), "row", "left_semi").dropDuplicates(["row"]).select("text", *HEADS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [of_text(text) for text in part.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *(part.column(i).cast(pa.float64()) for i in (1, 2))], names=["features", *HEADS])

    got = thin.mapInArrow(run, "features array<int>, quality double, toxic double").toArrow()
    rows = [x.values.to_numpy() for x in got["features"]]
    # the same order whatever the partitions
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes()))
    y = np.column_stack([got[head].to_numpy().astype(float) for head in HEADS]) if rows else np.zeros((0, 2))
    return Classifier.fit([rows[i] for i in order], y[order])


def scored(docs: DataFrame, classifier: Classifier, text_col: str, names: tuple[str, str]) -> DataFrame:
    """The rows with the classifier's two probabilities added."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # FEATURES weights a head, whatever the data
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for part in slices(batches, text_col):
            found = np.array([score(text or b"") for text in part.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found[:, 0]), pa.array(found[:, 1])], names=[*part.schema.names, *names])

    schema = docs.withColumns({name: F.lit(0.0) for name in names}).schema
    return small_batches(docs).mapInArrow(run, schema)


def strength(mean: Column, spread: Column) -> Column:
    """Prior sample size of a beta distribution with that mean and variance; large where nothing spreads."""
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / F.greatest(spread, F.lit(1e-9)) - 1))


def sites(evidence: DataFrame) -> DataFrame:
    """From rows host, path, quality, toxic: one row per (host, path) with <head>_shift, the log odds that
    the path's posterior adds to a document's."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(h).alias(f"s_{h}") for h in HEADS]).checkpoint()
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"s_{h}").alias(f"host_s_{h}") for h in HEADS])
    whole = hosts.agg(F.sum("host_n").alias("all_n"), F.count("*").alias("hosts"), *[F.sum(f"host_s_{h}").alias(f"all_s_{h}") for h in HEADS])
    if not (total := whole.first()).all_n:
        return paths.select("host", "path", *[F.lit(0.0).alias(f"{h}_shift") for h in HEADS])
    clip = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    logit = lambda x: F.log(x / (1 - x))
    mean = {h: min(1 - 1e-6, max(1e-6, total[f"all_s_{h}"] / total.all_n)) for h in HEADS}
    # spread between hosts beyond what their sizes explain
    spread = {h: F.sum(F.col("host_n") * F.pow(F.col(f"host_s_{h}") / F.col("host_n") - mean[h], 2)) / total.all_n - F.lit(mean[h] * (1 - mean[h]) * total.hosts / total.all_n) for h in HEADS}
    host_k = hosts.agg(*[strength(F.lit(mean[h]), spread[h]).alias(h) for h in HEADS]).first()
    hosts = hosts.withColumns({f"host_{h}": clip((F.col(f"host_s_{h}") + host_k[h] * mean[h]) / (F.col("host_n") + host_k[h])) for h in HEADS})
    both = paths.join(hosts, "host")
    inner = {h: F.sum(F.col("n") * F.pow(F.col(f"s_{h}") / F.col("n") - F.col(f"host_{h}"), 2)) / total.all_n - F.lit(mean[h] * (1 - mean[h])) * F.count("*") / total.all_n for h in HEADS}
    path_k = both.agg(*[strength(F.lit(mean[h]), inner[h]).alias(h) for h in HEADS]).first()
    posterior = {h: clip((F.col(f"s_{h}") + path_k[h] * F.col(f"host_{h}")) / (F.col("n") + path_k[h])) for h in HEADS}
    return both.select("host", "path", *[(logit(posterior[h]) - float(np.log(mean[h] / (1 - mean[h])))).alias(f"{h}_shift") for h in HEADS])


def few(table: DataFrame, most: int) -> bool:
    """Whether it may be broadcast, so that texts stay where they are."""
    return table.limit(most + 1).count() <= most


def classify(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
    host: Column | str = "source", path: Column | str = "lang", classifier: Classifier | None = None,
) -> DataFrame:
    """One row per document: doc_id, doc_quality and doc_toxic (the classifier alone), quality and toxic
    (with the site's posterior), keep."""
    shared_dir(docs.sparkSession)
    classifier = classifier or fit(docs, labels, sample, id_col, text_col)
    name = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    thin = docs.select(F.col(id_col).alias("doc_id"), name(host).alias("host"), name(path).alias("path"), F.col(text_col).alias("text"))
    found = scored(thin, classifier, "text", HEADS).drop("text").checkpoint()  # a short row a document
    shifts = sites(found)
    each = looked_up(found, shifts, ["host", "path"], "inner", few(shifts, MOST_SITES))
    sure = {h: log_odds(h, f"{h}_shift") for h in HEADS}
    return each.select(
        "doc_id", *[F.col(h).alias(f"doc_{h}") for h in HEADS], *[(1 / (1 + F.exp(-sure[h]))).alias(h) for h in HEADS],
        ((sure["quality"] >= 0) & (sure["toxic"] < 0)).alias("keep"),
    )


def log_odds(probability: str, shift: str) -> Column:
    return F.log(F.col(probability) / (1 - F.col(probability))) + F.col(shift)


def keep_good(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
    host: str = "source", path: str = "lang", classifier: Classifier | None = None,
) -> DataFrame:
    """The documents, all columns, that classify() keeps. With few sites, texts are scored twice (for the sites' sums
    and for the decision). With many, each text is scored once beside a key, the SHA-256 of all that the decision rests
    on; sites are looked up for (key, scores), and rejected keys taken out of the documents."""
    shared_dir(docs.sparkSession)
    classifier = classifier or fit(docs, labels, sample, id_col, text_col)
    prefix = "of_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    thin = docs.select(name(host).alias("host"), name(path).alias("path"), F.col(text_col).alias("text"))
    if not few(thin.select("host", "path").distinct(), MOST_SITES):
        # what the decision rests on, so rows that share a key share their fate
        key_of = lambda host, path, text: F.unhex(F.sha2(F.concat_ws("|", F.length(host), F.length(path), host, path, F.coalesce(F.col(text), F.lit(""))), 256))
        found = scored(thin.withColumn("key", key_of("host", "path", "text")), classifier, "text", HEADS).drop("text").checkpoint()  # a short row a document
        each = looked_up(found, sites(found), ["host", "path"], "inner", False)
        sure = {h: log_odds(h, f"{h}_shift") for h in HEADS}
        bad = each.where(~((sure["quality"] >= 0) & (sure["toxic"] < 0))).select(F.col("key").alias(f"{prefix}key")).distinct().checkpoint()
        keyed = docs.withColumns({f"{prefix}host": name(host), f"{prefix}path": name(path)})
        keyed = keyed.withColumn(f"{prefix}key", key_of(f"{prefix}host", f"{prefix}path", text_col))
        return looked_up(keyed, bad, [f"{prefix}key"], "left_anti", few(bad, MOST_SITES)).select(docs.columns)
    shifts = sites(scored(thin, classifier, "text", HEADS))
    shifts = shifts.select(F.col("host").alias(f"{prefix}host"), F.col("path").alias(f"{prefix}path"), *[F.col(f"{h}_shift").alias(f"{prefix}{h}_shift") for h in HEADS])
    each = scored(docs, classifier, text_col, (f"{prefix}doc_quality", f"{prefix}doc_toxic"))
    each = each.withColumns({f"{prefix}host": name(host), f"{prefix}path": name(path)}).join(F.broadcast(shifts), [f"{prefix}host", f"{prefix}path"])
    sure = {h: log_odds(f"{prefix}doc_{h}", f"{prefix}{h}_shift") for h in HEADS}
    return each.where((sure["quality"] >= 0) & (sure["toxic"] < 0)).select(docs.columns)
