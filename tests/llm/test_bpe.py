"""Byte-level BPE against the library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.llm.bpe import bpe_digests, bpe_encode, encoder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.v.ranks, special_tokens={})


def same(own, library, texts):
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert own.decode(ids) == (t or "").encode()


def test_fixed_texts(own, library):
    rnd = random.Random(1)
    letters = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    same(own, library, ["", None, " ", "a", "\n\n  x", "don't I'LL we'd", "<|endoftext|>", "a" * 3000, "ab" * 2000, letters("abcdefgh", 4000), letters("th eniour", 5000), "日本語" * 200, "é" * 700, "🙂🙃" * 300, letters("0123456789.,-", 900)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(own, library, texts):
    same(own, library, texts)


def test_query_rows(spark, library):
    rows = [(1, "Hello there, world"), (2, None), (3, ""), (None, "x y"), (1, "Hello there, world")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted(bpe_digests(docs).collect(), key=str)
    ids = [library.encode_ordinary(t or "") for _, t in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x), sha(np.array(x, dtype="<u4").tobytes()), sha((t or "").encode())) for (i, t), x in zip(rows, ids)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {tuple(r.ids) for r in bpe_encode(docs).collect()} == {tuple(x) for x in ids}
    assert bpe_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
