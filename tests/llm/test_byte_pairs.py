from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from souk.llm import byte_pairs
from souk.llm.queries import op11_byte_pairs

FILE = byte_pairs.default_vocabulary()


@pytest.fixture(scope="module")
def both():
    return byte_pairs.ByteCodec(byte_pairs.ByteVocabulary.load(FILE)), Tokenizer.from_file(FILE)


def same(both, texts):
    codec, library = both
    made = codec.lines(texts)
    for text, (line, back) in zip(texts, made, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert line == ",".join(map(str, ids)), repr(text)
        assert back == library.decode(ids, skip_special_tokens=False)
        assert codec.decode(ids) == back


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_texts(both, texts):
    same(both, texts)


def test_texts_made_of_tokens(both):
    rng = random.Random(3)
    signs = [t.decode("utf-8", "replace") for t in both[0].vocab.tokens if t]
    same(both, ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(3000)])


def test_every_code_point(both):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    codec, library = both
    for k in range(0, len(codes), 4000):
        text = "".join(f"a{chr(c)}b {chr(c)}1{chr(c)} " for c in codes[k:k + 4000])
        ours = codec.words(text)
        theirs = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert ours == theirs


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "\n\n a\r\n", "it's we'll I'D 'sx", "a" * 5000, " " * 3000 + "b", "-" * 2000,
                                  "ab" * 3000, "日本語 ☃ 🙂\0", "1234.5e-7", "x<|endoftext|>y <|endoftext|><|endoftext|>",
                                  "<|endoftext", "\x1c\x1d \x85a　b", "abcabcabd" * 700])
def test_edges(both, text):
    same(both, [text])


def test_prefixes_are_worked_out_once(both, monkeypatch):
    codec, library = both
    words = {" unbelievable"[:n] for n in range(1, 14)} | {" unbeliever", " unbent"}
    edges = []
    plain = codec.step_down
    monkeypatch.setattr(codec, "step_down", lambda edge, *lists: edges.append(edge) or plain(edge, *lists))
    out = codec.encode_words(words)
    assert sum(map(len, edges)) == len({w[:n] for w in words for n in range(1, len(w) + 1)})
    assert all(out[w] == library.encode(w).ids for w in words)


def test_full_table_starts_anew():
    codec = byte_pairs.ByteCodec(byte_pairs.ByteVocabulary.load(FILE), 5)
    library = Tokenizer.from_file(FILE)
    for k in range(6):
        text = " ".join(f"word{k}x{j}" for j in range(k))
        assert codec.encode(text) == library.encode(text).ids
        assert len(codec.table) <= 5


def test_documents(spark, both):
    rows = [(1, "the cat", 5), (1, "the cat", 5), (None, None, 6), (2, "", 7), (3, "é\n☃<|endoftext|>", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = byte_pairs.encode_documents(docs, FILE, with_ids=True, with_text=True).collect()
    assert len(out) == len(rows)
    for r in out:
        text = {1: "the cat", None: "", 2: "", 3: "é\n☃<|endoftext|>"}[r["doc_id"]]
        assert list(r["ids"]) == both[1].encode(text).ids and r["decoded"] == text and r["n_tokens"] == len(r["ids"])
    assert byte_pairs.encode_documents(docs.limit(0), FILE).collect() == []


def test_query_against_library(spark):
    library = Tokenizer.from_file(FILE)
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op11_byte_pairs(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest()
               for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *sha)
