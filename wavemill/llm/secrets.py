"""Secret scans: strong patterns, and weak parts of a credential that only count together.

Strong spans (assign, access, hex) are reported wherever they match. Weak parts are identifiers that a
key names (ident), unlabelled mixed-case strings with digits (blob) and addresses (endpoint); each is
everyday text by itself. An interval join within the document links parts whose gap is SCOPE code
points at most: an ident counts beside a secret (blob, assign or hex), a blob beside an identifier
(ident or access), an endpoint beside both. The join sorts both sides of a document along the text and
takes a running maximum of ends, so many parts in one text cost their number, not its square. All of it
is column expressions in one narrow stage: no shuffle, so no key can be hot, and a lost task only reads
its own input again.

Cases: a null text is the empty text. Rows without matches get zero counts and the hash of the empty
string. Repeated rows, null and repeated ids get one row each; other columns are ignored. Empty table:
empty result. Texts are scanned whole. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far apart the parts of one credential may stand, in code points.
SCOPE = 200
BLOCK = 64
#: Code points of the stretches that a text is cut from.
STRETCH = 4096

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As runs are taken whole from their left end, a least length in the pattern drops the same matches as a filter.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?i)(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BLOB = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"""(?<![A-Za-z0-9])(?:[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{1,5})"""
#: In this order where starts are equal.
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "blob": BLOB, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")
NONE = "array<struct<start:int,end:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once; Catalyst would do so wherever it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> Column:
    """For each item the fold over it and all before it; in blocks, so that many items do not cost their square."""

    def blockwise(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def carried(blocks: Column) -> Column:
        within = F.transform(blocks, lambda block: F.transform(block, lambda _, i: fold(F.slice(block, F.lit(1), i + 1))))
        before = let(F.transform(blocks, fold), lambda totals: F.transform(totals, lambda _, b: fold(F.slice(totals, F.lit(1), b))))
        return F.flatten(F.zip_with(within, before, lambda block, offset: F.transform(block, lambda x: both(x, offset))))

    return let(values, lambda values: let(blockwise(values), carried))


def running_sum(values: Column) -> Column:
    return running(values, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b), lambda x, before: x + before)


def running_max(values: Column) -> Column:
    return running(values, F.array_max, lambda x, before: F.greatest(x, before))


def located(text: str, found: str, pattern: str) -> Column:
    """Where the matches in the column found stand: array of (start, end)."""
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(m).alias("match"), F.length(g).alias("gap")))
    ends = let(pairs, lambda p: F.zip_with(p, running_sum(F.transform(p, lambda x: x["match"] + x["gap"])), lambda x, end: F.struct((end - x["match"]).alias("start"), end.alias("end"))))
    return F.when(F.size(found) > 0, ends).otherwise(F.array().cast(NONE))


def beside(ones: Column, others: Column) -> Column:
    """Those of the intervals that are within SCOPE of one of the others: of the others that begin early enough, the
    greatest end is late enough."""
    # along the text, others before ones of the same place
    theirs = F.transform(others, lambda x: F.struct(x["start"].alias("at"), F.lit(0).alias("mine"), x["end"].alias("reach"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    mine = F.transform(ones, lambda x: F.struct((x["end"] + SCOPE).alias("at"), F.lit(1).alias("mine"), F.lit(-1).alias("reach"), x["start"].alias("start"), x["end"].alias("end")))

    def swept(all_: Column) -> Column:
        reach = running_max(F.transform(all_, lambda x: x["reach"]))
        near = F.filter(F.zip_with(all_, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda y: (y["x"]["mine"] == 1) & (y["r"] >= 0) & (y["r"] >= y["x"]["start"] - SCOPE))
        return F.transform(near, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end")))

    return F.when((F.size(ones) > 0) & (F.size(others) > 0), let(F.sort_array(F.concat(theirs, mine)), swept)).otherwise(F.array().cast(NONE))


def with_spans(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The documents with columns <prefix>base and <prefix>all: arrays of (start, nth, end, kind), sorted;
    nth is the kind's place in KINDS. Takes the names <prefix>in_*, too."""
    text, at = f"{prefix}in_text", {kind: f"{prefix}in_{kind}" for kind in KINDS}
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({at[kind]: F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for kind, pattern in KINDS.items()})
    df = df.withColumns({f"{at[kind]}_at": located(text, at[kind], pattern) for kind, pattern in KINDS.items()})
    long_enough = F.transform(at["assign"], lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    df = df.withColumn(f"{at['assign']}_at", F.transform(F.filter(F.zip_with(f"{at['assign']}_at", long_enough, lambda x, ok: F.struct(x.alias("x"), ok.alias("ok"))), lambda x: x["ok"]), lambda x: x["x"]))
    span = {kind: F.col(f"{at[kind]}_at") for kind in KINDS}
    identifiers, secrets = F.concat(span["access"], span["ident"]), F.concat(span["assign"], span["hex"], span["blob"])
    linked = {
        "ident": beside(span["ident"], secrets),
        "blob": beside(span["blob"], identifiers),
        "endpoint": let(beside(span["endpoint"], identifiers), lambda near: beside(near, secrets)),
    }

    def marked(kind: str) -> Column:
        nth = list(KINDS).index(kind)
        return F.transform(linked.get(kind, span[kind]), lambda x: F.struct(x["start"], F.lit(nth).alias("nth"), x["end"], F.lit(kind).alias("kind")))

    df = df.withColumns({f"{prefix}base": F.array_sort(F.concat(*[marked(k) for k in BASE])), f"{prefix}all": F.array_sort(F.concat(*[marked(k) for k in KINDS]))})
    return df.drop(text, *at.values(), *[f"{x}_at" for x in at.values()])


def listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans, of kind:start:end."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", instead: str = "[REDACTED]") -> DataFrame:
    """The documents, all columns, with every reported span but the endpoints replaced in the text;
    spans that touch or overlap are replaced once. Null texts stay null."""
    prefix = "spans_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    found, all_spans = with_spans(docs, text_col, prefix), F.filter(f"{prefix}all", lambda x: x["kind"] != "endpoint")
    text, size = F.col(text_col), F.length(text_col)

    def kept(ends: Column) -> Column:
        """(start, end) of what stays: before each span that begins beyond all earlier ends, and after the last."""
        between = F.filter(
            F.transform(all_spans, lambda x, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)).alias("start"), x["start"].alias("end"), (i == 0).alias("first"))),
            lambda x: x["first"] | (x["end"] > x["start"]),
        )
        return F.concat(F.transform(between, lambda x: F.struct(x["start"], x["end"])), F.array(F.struct(F.element_at(ends, -1).alias("start"), size.alias("end"))))

    def cut(x: Column, stretches: Column) -> Column:
        # a place deep in a text is found by counting from its start, so pieces come from short stretches
        def piece(i: Column) -> Column:
            begin = F.greatest(x["start"] - i * STRETCH, F.lit(0))
            return F.substring(F.get(stretches, i), begin + 1, F.least(x["end"] - i * STRETCH, F.lit(STRETCH)) - begin)

        some = F.sequence((x["start"] / STRETCH).cast("int"), ((x["end"] - 1) / STRETCH).cast("int"))
        return F.when(x["end"] > x["start"], F.array_join(F.transform(some, piece), "")).otherwise(F.lit(""))

    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    ends = running_max(F.transform(all_spans, lambda x: x["end"]))
    new = let(stretches, lambda s: F.array_join(F.transform(let(ends, kept), lambda x: cut(x, s)), instead))
    return found.withColumn(text_col, F.when(F.size(all_spans) > 0, new).otherwise(text)).select(docs.columns)
