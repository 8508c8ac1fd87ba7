from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from souk.llm import pieces

MODEL = pieces.default_model()


@pytest.fixture(scope="module")
def both():
    return pieces.Codec(pieces.Vocabulary.load(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(both, text):
    codec, library = both
    ids = library.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)
    line = ",".join(map(str, ids))
    assert codec.digest(text) == (len(ids), hashlib.sha256(line.encode()).hexdigest(),
                                  hashlib.sha256(library.decode(ids).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_texts_made_of_pieces(both):
    rng = random.Random(2)
    names = list(both[0].id_of)
    for _ in range(1500):
        same(both, "".join(rng.choice(names) for _ in range(rng.randint(1, 8))))


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "\n\n a\r\n", "▁▁ x", "<s> </s> <0x41>", "a" * 5000, " " * 300 + "b",
                                  "ab" * 4000, "日本語 ☃ 🙂\0", "1234.5e-7"])
def test_edges(both, text):
    same(both, text)


def test_documents(spark, both):
    rows = [(1, "the cat", 5), (1, "the cat", 5), (None, None, 6), (2, "", 7), (3, "é\n☃", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = pieces.encode_documents(docs, MODEL, with_ids=True, with_text=True).collect()
    assert len(out) == len(rows)
    for r in out:
        text = {1: "the cat", None: "", 2: "", 3: "é\n☃"}[r["doc_id"]]
        assert list(r["ids"]) == both[1].encode(text) and r["decoded"] == text and r["n_tokens"] == len(r["ids"])
    assert pieces.encode_documents(docs.limit(0), MODEL).collect() == []
