import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from wavemill.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TOKTOK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", " ", "don't  stop \t\n x", "été ½ x² 日本語 😀😀 'S 'll", "aaaa" * 700, "\x1c\x85​\xa0 !?", "the the the", "Ⅷ numbers 123456",
    "<|endoftext|> ‘quoted’", "abc" * 3000,
]


def rows(spark):
    docs = [(i, x, "clash") for i, x in enumerate(TEXTS)] + [(None, "no id", "x"), (5, TEXTS[5], "again"), (99, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_tokens string")


def test_encodes_as_tiktoken_and_round_trips(spark):
    got = bpe.encode(rows(spark), RANKS, public_tokenizers.PATTERN, with_digests=True).collect()
    assert len(got) == len(TEXTS) + 3
    for row in got:
        text = "no id" if row.doc_id is None else "" if row.doc_id == 99 else TEXTS[row.doc_id]
        ids = TOKTOK.encode_ordinary(text)
        assert list(row.ids) == ids and row.n_tokens == len(ids)
        assert bytes(row.decoded) == text.encode()
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decode(spark):
    encoded = bpe.encode(rows(spark), RANKS, public_tokenizers.PATTERN)
    for row in bpe.decode(encoded, RANKS).where("doc_id is not null").collect():
        assert bytes(row.decoded) == ("" if row.doc_id == 99 else TEXTS[row.doc_id]).encode()


def test_every_character_is_cut_as_by_tiktoken():
    text = "".join(f"a{chr(c)} 1{chr(c)}" for c in range(0x2500))
    (ids, decoded), *_ = bpe.Memory(RANKS, public_tokenizers.PATTERN).look_up([text])
    assert np.frombuffer(ids, "<u4").tolist() == TOKTOK.encode_ordinary(text) and decoded == text.encode()


def test_forgetting_words_changes_nothing():
    known = bpe.Memory(RANKS, public_tokenizers.PATTERN, remembered=3)
    for text in TEXTS * 2:
        ((ids, _),) = known.look_up([text])
        assert np.frombuffer(ids, "<u4").tolist() == TOKTOK.encode_ordinary(text)


def test_a_vocabulary_with_falling_ranks_is_encoded_step_by_step():
    """Tokens of a lower rank than their parts: the query for long words would contract too much at once."""
    odd = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 5, b"abab": 2, b"ba": 7, b"aba": 3, b"bc": 4, b"cd": 500, b"abcd": 1}
    coder = bpe.Bpe(odd)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while (best := min(((odd[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in odd), default=None)):
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [odd[x] for x in parts]

    for word in (b"abababa" * 30, b"ba" * 100 + b"x", b"a" * 200, b"abcd" * 50, b"cdab" * 40):
        ((ids, piece),) = coder.encode([word])
        assert np.frombuffer(ids, "<u4").tolist() == plain(word) and piece == word
    assert coder.sound is False
    sound = bpe.Bpe(RANKS)
    sound.encode([b"abc" * 100])
    assert sound.sound is True


def test_huge_words_go_in_stretches(monkeypatch):
    import random

    rng = random.Random(4)
    words = ["a" * 5003, "ab" * 2500, "é日" * 900, "".join(rng.choices("theinga", k=6000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(2000)), "the" * 1500 + "s", "=" * 4001]
    want = [TOKTOK._encode_single_piece(w.encode()) for w in words]
    for size, tail in ((700, 4), (1500, 16)):
        monkeypatch.setattr(bpe, "HUGE", size), monkeypatch.setattr(bpe, "TAIL", tail)
        for word, ids, (got, piece) in zip(words, want, bpe.Bpe(RANKS).encode([w.encode() for w in words]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids and piece == word.encode()


def test_words_of_megabytes_in_bounded_memory():
    """The database has 300 MB; a word of 4 MB does not fit at once."""
    word = "a" * 4_000_000
    ((got, piece),) = bpe.Bpe(RANKS).encode([word.encode()])
    ids = np.frombuffer(got, "<u4")
    assert piece == word.encode()
    few = TOKTOK._encode_single_piece(b"a" * 4000)  # one token over and over, then what is left of the word
    n = len(TOKTOK.decode(few[:1]))
    assert set(ids[:-8].tolist()) == {few[0]} and len(ids) - 8 <= 4_000_000 // n
    assert TOKTOK.decode(ids[-8:].tolist()) == "a" * (4_000_000 - n * (len(ids) - 8))
    assert ids[-8:].tolist() == TOKTOK._encode_single_piece(TOKTOK.decode(ids[-8:].tolist()).encode())


def test_bytes_of_ids_are_those_of_the_vocabulary():
    coder = bpe.Bpe(RANKS)
    ids = np.random.default_rng(0).integers(0, len(RANKS), 300_000).astype("<u4")
    of = {i: token for token, i in RANKS.items()}
    decoded, past = coder.bytes_of(ids.tobytes())
    assert decoded == b"".join(of[i] for i in ids.tolist()) and past[-1] == len(decoded)
    assert coder.bytes_of(b"")[0] == b""


def test_empty_table(spark):
    assert bpe.encode(rows(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
