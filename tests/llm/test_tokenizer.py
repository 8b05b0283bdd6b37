import os
import random

import pytest

from graphloom.llm import tokenizer as T

VOCAB = T.DEFAULT_VOCABULARY
pytestmark = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def bpe():
    return T.Bpe(T.load_ranks(VOCAB))


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(VOCAB), special_tokens={})


TEXTS = [
    "hello world", "  two  spaces\n\n\ttab ", "don't we'll I'M", "snake_case camelCase HTTPServer2", "日本語と中文。", "é é ñ", "😀👩‍👩‍👧‍👦", "﻿bom\r\ncrlf", "a" * 5000, "ab" * 3000,
    "0123456789" * 30, "<|endoftext|>", "x = {'a': [1, 2.5e-3]}", "\x00\x01", "   ", "\n",
]


def test_same_as_other_implementation(bpe, other):
    rng = random.Random(7)
    pieces = ["ing", "tion", " the", "é", "日", "😀", "a", "b", "xq", "0", "_", " ", "\n", "ß", "Ω"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randrange(1, 300))) for _ in range(300)]
    texts += ["".join(rng.choices("abcdefghijklmnop", k=k)) for k in (50, 4000, 4096, 4097, 12000)]
    for t in texts:
        assert bpe.encode(t) == other.encode_ordinary(t), t[:60]


def test_word_is_the_merge_definition(bpe):
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choices(b"abcdet ing\xc3\xa9", k=rng.randrange(1, 25)))
        assert list(bpe.word(data)) == bpe.merge(data)


def test_round_trip_and_stream(bpe):
    for t in TEXTS:
        assert bpe.decode(bpe.encode(t)) == t
    stream = T.Utf8Stream()
    assert "".join(stream.feed(bytes([b])) for b in "é😀".encode()) + stream.end() == "é😀"
    stream = T.Utf8Stream()
    assert stream.feed(b"\xf0\x9f") + stream.end() == "�"


def test_documents(spark, bpe):
    rows = [(1, "hello", "x"), (2, "", "x"), (3, None, "x"), (4, "hello", "x"), (5, "a b" * 9000, None)]
    got = {r["doc_id"]: r["ids"] for r in T.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    assert got == {1: bpe.encode("hello"), 2: [], 3: [], 4: bpe.encode("hello"), 5: bpe.encode("a b" * 9000)}
    back = T.decode_documents(T.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string")))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "hello", 2: "", 3: "", 4: "hello", 5: "a b" * 9000}
    assert T.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
