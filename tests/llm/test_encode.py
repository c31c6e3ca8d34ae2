import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm.encode import Encoder, encode_texts, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary_path()


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encode():
    return Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_public_library(reference, encode, text):
    assert encode([text])[0] == reference.encode(text, add_special_tokens=False).ids


def test_texts_of_all_kinds(reference, encode):
    texts = ["aaaa" * 500, "<|endoftext|>", " \t\n  x", "don't I'LL 're", "a b　c\x1c\x85", "x" * 50_000, "🔧🇳🇿👩‍🔧", "é" * 30, "up\n" * 2000]
    random.seed(2)
    texts += ["".join(chr(random.choice([random.randrange(0x20, 0x500), random.randrange(0x3040, 0x30FF), 32])) for _ in range(80)) for _ in range(300)]
    assert encode(texts) == [t.ids for t in reference.encode_batch(texts, add_special_tokens=False)]


def test_words_in_any_grouping(encode):
    words = ["hello", " world", "ing", "aaaaaaa", "été", " the"]
    alone = [Encoder(PATH).table.encode_words([w])[0] for w in words]
    assert encode.table.encode_words(words) == alone
    few = Encoder(PATH, most=2)
    assert few(["hello world"] * 3 + ["the étés"]) == [encode(["hello world"])[0]] * 3 + [encode(["the étés"])[0]]


def test_nulls_empties_and_repeated_rows(spark, reference):
    rows = [(1, "hello", "x"), (1, "hello", "x"), (2, "", "x"), (3, None, "x"), (None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encode_texts(df, "text", ["doc_id"]).collect()), key=str)
    hello, ab = (reference.encode(t, add_special_tokens=False).ids for t in ("hello", "a b"))
    assert got == sorted([(1, hello), (1, hello), (2, []), (3, []), (None, ab)], key=str)
    lengths = {r["doc_id"]: r["n_tokens"] for r in encode_texts(df, "text", ["doc_id"], lengths=True).collect()}
    assert lengths == {1: len(hello), 2: 0, 3: 0, None: len(ab)}
    assert encode_texts(spark.createDataFrame([], df.schema), "text", ["doc_id"]).count() == 0
