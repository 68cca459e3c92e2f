"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

Spark partitions the documents; in a task, the distinct pattern matches ("words") that the task has
not met lately go to DuckDB as token-position rows. A recursive query joins neighbouring positions
with the merge table and contracts each word's leftmost pair of least rank until no pair is left; an
ordered aggregation over the positions decodes. A text's ids are its words' ids in order, so each distinct word is
worked out once. A text's decoded bytes are those of its ids, in order, and have to be its words' decoded bytes.

Cases: a null text is the empty text (no ids, the hash of no bytes); null or repeated ids and
repeated rows are kept, one output row per input row; an empty table gives an empty result; other
columns of the input are ignored, so their names cannot clash. Texts of any length and words of any
length are encoded whole. A word of more than HUGE bytes goes through bounded tables: a stretch at a time is contracted, and
all but its last tokens stand if the first of them may follow the one before. Tokens in a row are a word's encoding if
each two neighbours are the encoding of their own bytes, so stretches give the ids of the whole. A stretch costs a turn
for each rank that it is contracted at: some 10 s a MB. Every Unicode string round-trips, as all 256 bytes are tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

#: The pattern that the fast path for Latin-1 texts knows; any other works without it.
STANDARD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a task remembers: two generations of this many (some 50 MB). Forgotten words are encoded again.
REMEMBERED = 100_000
#: Words, and bytes of words, that go to DuckDB at once.
AT_ONCE, BYTES_AT_ONCE = 20_000, 1 << 19
#: Longer words take the query that contracts several places a turn and runs this many turns at a time, fewer if
#: that made more than so many rows.
LONG, TURNS, ROWS = 128, 16, 2 << 20
#: Bytes of a stretch of a longer word, and its last tokens that wait for the next stretch.
HUGE, TAIL = 1 << 19, 64

#: A position's key is word * 2^40 + place, so that a place's right neighbour is one join away.
ENCODE = """
CREATE OR REPLACE TABLE tokens AS
WITH RECURSIVE step AS (
    SELECT key, 0 AS turn, id FROM letters
    UNION ALL
    SELECT CASE WHEN key > spot THEN key - 1 ELSE key END, turn + 1, CASE WHEN key = spot THEN merged ELSE id END
    FROM step JOIN (
        SELECT word, min((m.id << 40) + place) AS best, best >> 40 AS merged, (word << 40) + (best & 1099511627775) AS spot
        FROM (
            SELECT a.key >> 40 AS word, a.key & 1099511627775 AS place, (a.id << 17) + b.id AS neighbours
            FROM step a JOIN step b ON b.key = a.key + 1
        ) JOIN merges m ON m.pair = neighbours
        GROUP BY word
    ) ON word = key >> 40
    WHERE key <> spot + 1
)
SELECT key >> 40 AS row, key & 1099511627775 AS pos, id
FROM step JOIN (SELECT key >> 40 AS word, max(turn) AS turn FROM step WHERE key & 1099511627775 = 0 GROUP BY key) ends
    ON ends.word = key >> 40 AND ends.turn = step.turn
"""
#: For long words: in each turn, the leftmost place of the word's least rank and the others of that rank that do not
#: overlap it, which are the next to be contracted: a vocabulary whose tokens encode to themselves (which is checked
#: before the first long word) has no pair of lower rank that one of these contractions could make.
ENCODE_LONG = """
CREATE OR REPLACE TABLE reached AS
WITH RECURSIVE step AS (
    SELECT key, 0 AS turn, id FROM letters
    UNION ALL
    SELECT key - coalesce(sum(spot) OVER (PARTITION BY word ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), turn + 1, CASE spot WHEN 1 THEN least ELSE id END
    FROM (
        SELECT s.key, s.key >> 40 AS word, turn, s.id, w.least, CASE WHEN spots.key IS NULL THEN 0 ELSE 1 END AS spot
        FROM step s
        JOIN (
            SELECT a.key >> 40 AS word, min(m.id) AS least
            FROM step a JOIN step b ON b.key = a.key + 1 JOIN merges m ON m.pair = (a.id << 17) + b.id GROUP BY word
        ) w ON w.word = s.key >> 40
        LEFT JOIN (
            SELECT key FROM (
                SELECT key, row_number() OVER (PARTITION BY run ORDER BY key) AS nth
                FROM (
                    SELECT key, key - row_number() OVER (ORDER BY key) AS run
                    FROM (
                        SELECT a.key, m.id, min(m.id) OVER (PARTITION BY a.key >> 40) AS least
                        FROM step a JOIN step b ON b.key = a.key + 1 JOIN merges m ON m.pair = (a.id << 17) + b.id
                    ) WHERE id = least
                )
            ) WHERE nth % 2 = 1
        ) spots ON spots.key = s.key
        WHERE turn < {turns}
    )
    QUALIFY coalesce(lag(spot) OVER (PARTITION BY word ORDER BY key), 0) = 0
)
SELECT key, id, step.turn FROM step JOIN (SELECT key >> 40 AS word, max(turn) AS turn FROM step WHERE key & 1099511627775 = 0 GROUP BY key) ends
    ON ends.word = key >> 40 AND ends.turn = step.turn
"""
IDS = "SELECT row, id FROM tokens ORDER BY row, pos"
#: Blobs have no ordered concatenation, their hexadecimal digits have.
DECODE = """
SELECT row, string_agg(digits, '' ORDER BY pos) AS piece
FROM tokens JOIN vocabulary USING (id) GROUP BY row ORDER BY row
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """The vocabulary and its merge table in an in-memory DuckDB."""

    def __init__(self, ranks: dict[bytes, int], memory_mb: int = 300):
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": ""})
        merges = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        l, r, m = np.array(merges, dtype=np.int64).reshape(-1, 3).T
        if len(ranks) and max(ranks.values()) >= 1 << 17:
            raise ValueError("ids of 17 bits at most")
        self.tokens, self.sound = ranks, None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.put("merges", pa.table({"pair": (l << 17) + r, "id": m}))
        self.put("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int64()), "digits": [token.hex() for token in ranks]}))
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        sizes = np.zeros(int(self.ids.max(initial=0)) + 2, np.int64)
        sizes[self.ids] = np.fromiter(map(len, ranks), np.int64, len(ranks))
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        self.all_bytes = np.frombuffer(b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def put(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids, as little-endian unsigned 32-bit integers, and decoded bytes of each word (of one byte or more)."""
        out: list = [None] * len(words)
        longest = max(map(len, words), default=0)
        if longest > LONG and self.sound is None:
            self.sound = True  # for the tokens themselves, which take the query for short words
            some = [token for token in self.tokens if len(token) <= LONG]
            found = self.encode(some)
            self.sound = all(ids == self.tokens[token].to_bytes(4, "little") for token, (ids, _) in zip(some, found, strict=True))
        most = LONG if self.sound else longest
        for i, word in enumerate(words):
            if len(word) > HUGE and self.sound:
                out[i] = self.encode_huge(word)
        short, long = [i for i, w in enumerate(words) if len(w) <= most], [i for i, w in enumerate(words) if len(w) > most and out[i] is None]
        for numbers, is_long in ((short, False), (long, True)):
            for some in bounded(numbers, words):
                for i, found in zip(some, self.encode_some([words[i] for i in some], is_long), strict=True):
                    out[i] = found
        return out

    def encode_huge(self, word: bytes) -> tuple[bytes, bytes]:
        """Stretch by stretch: what stands so far, and from its end on (place at) what is still to be contracted."""
        stands, decoded, at, end, back = array("I"), bytearray(), 0, 0, TAIL
        while at < len(word):
            end = min(len(word), max(end, at) + HUGE)
            ids, piece = next(self.encode_some([word[at:end]], True))
            ids = np.frombuffer(ids, "<u4")
            while stands and not self.follows(stands[-1], int(ids[0])):
                again = np.array(stands[-back:])  # more of what stood is contracted again
                del stands[-back:]
                at -= int(self.sizes[again].sum())
                del decoded[at:]
                back *= 2
                ids, piece = next(self.encode_some([word[at:end]], True))
                ids = np.frombuffer(ids, "<u4")
            if end < len(word):
                ids = ids[:-TAIL]
            n, back = int(self.sizes[ids].sum()), TAIL
            stands.extend(ids.tolist())
            decoded += piece[:n]
            at += n
        return np.array(stands, "<u4").tobytes(), bytes(decoded)

    def follows(self, one: int, other: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        key = (one, other)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 100_000:
                self.pairs.clear()
            word = b"".join(self.all_bytes[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes() for i in key)
            known = self.pairs[key] = next(self.encode_some([word], len(word) > LONG))[0] == np.array(key, "<u4").tobytes()
        return known

    def encode_some(self, words: list[bytes], is_long: bool) -> Iterator[tuple[bytes, bytes]]:
        row, pos = places(words)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        self.put("letters", pa.table({"key": (row << 40) + pos, "id": ids}))
        if is_long:
            while True:
                turns = max(1, min(TURNS, ROWS // len(ids)))
                self.db.execute(ENCODE_LONG.format(turns=turns))
                if self.db.execute("SELECT max(turn) FROM reached").fetchall()[0][0] < turns:
                    break
                self.db.execute("CREATE OR REPLACE TABLE letters AS SELECT key, id FROM reached")
            self.db.execute("CREATE OR REPLACE TABLE tokens AS SELECT key >> 40 AS row, key & 1099511627775 AS pos, id FROM reached")
        else:
            self.db.execute(ENCODE)
        got = self.db.execute(IDS).fetchnumpy()
        flat, ends = got["id"].astype("<u4").tobytes(), 4 * np.searchsorted(got["row"], np.arange(len(words) + 1))
        for a, b, piece in zip(ends[:-1], ends[1:], self.pieces(len(words)), strict=True):
            yield flat[a:b], piece

    def pieces(self, n: int) -> list[bytes]:
        """The bytes of rows 0 to n - 1 of the token table, by an ordered aggregation over their positions."""
        got = self.db.execute(DECODE).fetchall()
        if len(got) == n:
            return [bytes.fromhex(digits) for _, digits in got]
        found = dict(got)
        return [bytes.fromhex(found.get(i, "")) for i in range(n)]

    def bytes_of(self, ids: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes of ids (little-endian, 32 bits) in order, and where each id's end."""
        flat, out = np.frombuffer(ids, "<u4"), []
        for a in range(0, len(flat), 1 << 17):  # some at a time, for the places of their bytes take room
            some = flat[a : a + (1 << 17)]
            n = self.sizes[some]
            begin = np.cumsum(n) - n
            out.append(self.all_bytes[np.repeat(self.starts[some] - begin, n) + np.arange(n.sum())].tobytes())
        return b"".join(out), np.cumsum(self.sizes[flat])

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids; ids outside the vocabulary are an error."""
        row, pos = places(rows)
        flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        if not np.isin(flat, self.ids).all():
            raise ValueError("ids outside the vocabulary")
        self.put("tokens", pa.table({"row": row, "pos": pos, "id": flat}))
        return self.pieces(len(rows))


def bounded(numbers: list[int], words: list[bytes]) -> Iterator[list[int]]:
    some, size = [], 0
    for i in numbers:
        if some and (len(some) == AT_ONCE or size + len(words[i]) > BYTES_AT_ONCE):
            yield some
            some, size = [], 0
        some.append(i)
        size += len(words[i])
    if some:
        yield some


def places(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place in its row of each item of the rows."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.repeat(np.arange(len(rows)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


#: PATTERN's classes for texts of Latin-1 letters, where the standard library's faster engine can name each character.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
SPACE = "\\t-\\r \x85\xa0"
LATIN_WORDS = re.compile(f" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{SPACE}{LATIN}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Latin-1 numerals that are not decimal digits.
NUMERALS = "\xb2\xb3\xb9\xbc\xbd\xbe"


class Words:
    """The pattern's matches in a text; the words that a text is cut into."""

    def __init__(self, pattern: str):
        self.all, self.latin = regex.compile(pattern), pattern == STANDARD

    def __call__(self, text: str) -> list[str]:
        if self.latin:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.all.findall(text)
            if not any(x in text for x in NUMERALS):
                return LATIN_WORDS.findall(text)
        return self.all.findall(text)


class Memory:
    """What a task remembers from one slice to the next: the ids of words, and the decoded bytes of those
    (none, unless the vocabulary is broken) that do not decode to themselves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.bpe, self.words, self.remembered = Bpe(ranks), Words(pattern), remembered
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.changed: dict[str, bytes] = {}

    def look_up(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each text."""
        found = [self.words(text) for text in texts]
        distinct = set().union(*found)
        if len(self.new) > self.remembered:
            self.old, self.new = self.new, {}
        missing = []
        for word in distinct.difference(self.new):
            if (ids := self.old.get(word)) is None:
                missing.append(word)
            else:
                self.new[word] = ids
        raw = [word.encode() for word in missing]
        for word, was, (ids, piece) in zip(missing, raw, self.bpe.encode(raw), strict=True):
            self.new[word] = ids
            if piece != was:
                self.changed[word] = piece
        ids_of = self.new.__getitem__
        all_ids = [b"".join(map(ids_of, words)) for words in found]
        decoded, past = self.bpe.bytes_of(b"".join(all_ids))
        if decoded != ("".join(map("".join, found)).encode() if not self.changed else b"".join(self.changed.get(x) or x.encode() for words in found for x in words)):
            raise RuntimeError("texts and words decode apart")
        place = begin = 0
        for ids in all_ids:
            place += len(ids) // 4
            end = int(past[place - 1]) if place else 0
            yield ids, decoded[begin:end]
            begin = end

    def forget(self) -> None:
        """A worker outlives its tasks, and other work shares its memory."""
        self.new, self.old = {}, {}
        for name in ("letters", "tokens", "reached"):
            self.bpe.db.execute(f"DROP TABLE IF EXISTS {name}")


_memory: dict[tuple, Memory] = {}


def memory(ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> Memory:
    """One merge table per Python worker and vocabulary; Spark uses workers again for later tasks."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern, remembered)
    if key not in _memory:
        _memory.clear()
        _memory[key] = Memory(ranks, pattern, remembered)
    return _memory[key]


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True, with_digests: bool = False, remembered: int = REMEMBERED, with_decoded: bool | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, and as wanted ids (array of int), decoded (binary; with the ids, unless said), or
    their digests ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary file's size, not the data's
    id_type = docs.schema[id_col].dataType.simpleString()
    with_decoded = with_ids if with_decoded is None else with_decoded
    schema = f"doc_id {id_type}, n_tokens bigint" + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded + ", ids_sha256 string, decoded_sha256 string" * with_digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(shared.value, pattern, remembered)
        for part in slices(batches, max_bytes=1 << 20):
            rows = []
            for ids, decoded in known.look_up(part.column(1).to_pylist()):
                row = [len(ids) // 4]
                if with_ids:
                    row += [np.frombuffer(ids, "<u4").astype(np.int32)]
                if with_decoded:
                    row += [decoded]
                if with_digests:
                    row += [hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                rows.append(row)
            types = [pa.int64(), *[pa.list_(pa.int32())] * with_ids, *[pa.binary()] * with_decoded, *[pa.string(), pa.string()] * with_digests]
            names = ["doc_id", "n_tokens", *["ids"] * with_ids, *["decoded"] * with_decoded, *["ids_sha256", "decoded_sha256"] * with_digests]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)
        known.forget()

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of rows of ids; null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    thin = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = memory(shared.value, ".").bpe
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [np.asarray(x, dtype=np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.decode(rows), pa.binary())], names=["doc_id", "decoded"])

    return thin.mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, decoded binary")
