"""Operator 4 against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillscan.llm.bpe import Bpe, bpe_columns, public_path


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return Bpe.load(public_path()), Tokenizer.from_file(public_path())


def same(both, text):
    own, other = both
    ids = other.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == other.decode(ids, skip_special_tokens=False)


PIECES = [*"abcdefgh ABZ \n\t\r\x0b\x1c\x85\xa0 　'0123٣½éß漢😀́.,!<|>#\x00﻿", "<|endoftext|>", "'re", "  ", "ing", "the"]


def test_random_mixes(both):
    draw = random.Random(5)
    for _ in range(1500):
        same(both, "".join(draw.choices(PIECES, k=draw.randint(0, 40))))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(both, text):
    same(both, text)


def test_long_words(both):
    for text in ("a" * 5000, "ab" * 3000, "é" * 2000, " " * 3000, "!?" * 2000):
        same(both, text)


def test_columns(spark, both):
    rows = [(1, "hello world", 3), (2, None, 4), (3, "", 5), (1, "hello world", 3), (4, "x y " * 30000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe_columns(df, public_path(), outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"))
    got = out.orderBy("doc_id").collect()
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]
    for r in got:
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), r.text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe_columns(df.limit(0), public_path()).count() == 0
