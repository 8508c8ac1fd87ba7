from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from souk.llm import repeats


def brute(texts: list[str | None], length: int):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed: int, length: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(length // 2)) for _ in range(4)]
    texts: list[str | None] = [None, "", "a", "ab" * length, "z" * (3 * length), "z" * length, "z" * (length - 1)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            k = rng.random()
            if k < 0.4:
                p = rng.choice(passage)
                a = rng.randint(0, len(p) // 2)
                parts.append(p[a:a + rng.randint(length // 2, len(p))])
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(1, length // 2))))
        texts.append(" ".join(parts))
    texts += texts[10:14] + [texts[20]] * 3
    return texts


@pytest.mark.parametrize("seed,length,trigger,limit", [(1, 40, 12, 10**6), (2, 64, 16, 10**6), (3, 40, 12, 2), (4, 200, 64, 10**6)])
def test_report_equals_brute_force(spark, seed, length, trigger, limit):
    texts = corpus(seed, length)
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = repeats.repeat_report(docs.repartition(3), length, trigger=trigger, group_limit=limit).collect()
    want = [((i if i % 9 else None), *x) for i, x in enumerate(brute(texts, length))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_long_text_is_parsed_in_blocks(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcd ") for _ in range(5000)).encode()
    monkeypatch.setattr(repeats, "BLOCK", 700)
    _, _, _, _, lo, hi = repeats.parse([text, text[:300]], 50, 16)
    assert (hi - lo + 1).sum() == (5000 - 49) + (300 - 49)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, k1 string, spans int")
    assert repeats.repeat_report(docs).collect() == []


def test_remove_keeps_columns_and_whole_characters(spark):
    p = "é" * 150
    docs = spark.createDataFrame([(1, "x " + p, "a"), (2, p + " y", "b"), (3, None, "c"), (3, "short", "c")],
                                 "doc_id long, text string, __source string")
    out = {(r["doc_id"], r["__source"], r["text"]) for r in repeats.remove_repeats(docs).collect()}
    assert out == {(1, "a", "x "), (2, "b", " y"), (3, "c", None), (3, "c", "short")}
