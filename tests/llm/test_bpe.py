"""Byte pair encoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quizmill.llm import bpe, queries

PIECES = ["a", "b", "é", " ", "  ", "\n", "\r\n", "\t", "1", "22", "<|endoftext|>", "<|endof", "'s", "'ll", "\u0085", "\x1c", " ", "漢", "😀", "́", "꟎", "\x00", "!", "the", " the", "ing", "﻿", "ﬁ", "٣", "²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(bpe.read(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def table():
    return bpe.Decoder(bpe.read(bpe.VOCABULARY))


def test_any_mixture_of_pieces(library, own, table):
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == ids, repr(text)
        assert table.text(ids) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode(library, table):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(6))]
        assert table.text(ids) == library.decode(ids, skip_special_tokens=False)
    assert table.text([-1, 10**9]) == ""


def test_special_tokens_as_plain_text(library):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    text = "x <|endoftext|> y<|endoftext|>"
    without = bpe.Tokenizer(bpe.read(bpe.VOCABULARY), special=False)
    assert without.ids(text) == plain.encode(text, add_special_tokens=False).ids
    assert without.ids(text) != library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [2, 255, 256, 257, 258, 1000, 40000])
def test_long_words(library, own, size):
    rng = random.Random(size)
    for word in ("a" * size, ("ab" * size)[:size], "é" * size, "!" * size, " " * size, "".join(rng.choice("abcdest") for _ in range(size))):
        assert own.ids(word) == library.encode(word, add_special_tokens=False).ids


def test_both_forms_of_a_word_agree(own):
    rng = random.Random(5)
    for _ in range(500):
        word = "".join(rng.choice("aeinrst hé") for _ in range(rng.randrange(2, 60))).encode()
        assert own._long(word) == own.word(word)


def test_words_merge_together_as_alone(own):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinrst hé漢.") for _ in range(rng.randrange(1, 40))).encode() for _ in range(3000)] + [b"a", b"\0", b"\0\0the", b"x" * 256]
    assert own.together(words) == [bpe.packed(own.word(w)) for w in words]
    assert own.together([]) == []


def test_a_small_memory_changes_nothing(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    fresh = bpe.Tokenizer(bpe.read(bpe.VOCABULARY))
    text = "some words come again and again, some words do not come again " * 5
    assert fresh.ids(text) == own.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_odd_rows_round_trip(spark, odd, odd_rows, library):
    named = odd.withColumnRenamed("gone", "ids").withColumnRenamed("score", "decoded")
    got = bpe.decode(bpe.encode(named))
    assert set(got.columns) == set(named.columns)
    rows = got.select("doc_id", "text", "ids", "decoded", "n", "held_out").collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.encode(odd.filter("false")).count() == 0
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()] == ["", ""]


def test_query_over_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer(bpe.read(public_tokenizers.path("word_bpe_49k.json")))
