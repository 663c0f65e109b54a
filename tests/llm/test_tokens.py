import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from choralis.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")
TEXTS = [None, "", " ", "Hello world", "<|endoftext|> here", "é日本語🎤 it's\r\n\r\n  x", "a" * 3000, " " * 3000, "日本" * 1500, "\x00\x01\t"]


def long_text(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["word ", "it's", " don't", "   ", "\n\n", "日本語", "42 ", "é", "!?", "\t", "aaaa"]) for _ in range(2500))


def test_round_trip_and_same_as_whole(spark):
    texts = TEXTS + [long_text(i) for i in range(6)]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, k int")
    enc = T.vocabulary()
    for chunk, overlap, giant in ((T.CHUNK, T.OVERLAP, T.GIANT), (700, 200, 2000), (97, 30, 50), (97, 30, T.GIANT)):
        got = {r["doc_id"]: r["ids"] for r in T.encode(df, chunk=chunk, overlap=overlap, giant=giant).collect()}
        for i, t in enumerate(texts):
            assert got[i] == (enc.encode_ordinary(t) if t else []), (chunk, i)
            assert T.decode(got[i]) == (t or "")


def test_long_texts_are_cut():
    """The method runs: texts above a chunk are several pieces, and the pieces are the text."""
    for i in range(3):
        t = long_text(i)
        ps = T.pieces(t)
        assert "".join(ps) == t and len(ps) >= len(t) // T.CHUNK - 1 > 1
    for t in ("a" * 9000, " " * 9000, "日本" * 4500):
        assert "".join(T.pieces(t)) == t


@given(st.text("ab1 '\n\tré.日\u00a0\x1c", max_size=400), st.integers(20, 90), st.integers(6, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_encode_as_the_whole(text, chunk, overlap):
    enc = T.vocabulary()
    assert [i for p in T.pieces(text, chunk, overlap) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_same_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for s in [x for x in TEXTS if x] + [long_text(9)]:
        assert t.encode(s, add_special_tokens=False).ids == T.vocabulary().encode_ordinary(s)


def test_empty_and_repeated(spark):
    schema = "doc_id bigint, text string"
    assert T.encode(spark.createDataFrame([], schema)).collect() == []
    assert T.encode(spark.createDataFrame([(1, "a b"), (1, "a b")], schema)).count() == 2
