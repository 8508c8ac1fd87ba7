from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from souk.llm import word_runs
from souk.llm.queries import op13_word_runs, with_planted_periods


def brute(words, min_length=6, min_exponent=4):
    """Every maximal stretch of every period; a stretch counts with its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - k >= 2 * q:
                found.setdefault((k, end + q), q)
            k = end
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(min_length, min_exponent * q))


def runs_of(texts, min_length=6, min_exponent=4):
    return word_runs.chunk_runs(texts, min_length, min_exponent)


def random_texts(rng, count):
    out = []
    for _ in range(count):
        words = [b"%d" % rng.randrange(rng.choice((2, 3, 9))) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            block = [b"%d" % rng.randrange(4) for _ in range(rng.randint(1, 6))]
            words += (block * rng.randint(2, 6))[:rng.randint(2, 40)]
        out.append(words)
    return out


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (2, 2), (1, 3)])
def test_random_texts(min_length, min_exponent, monkeypatch):
    monkeypatch.setattr(word_runs, "BLOCK_TESTS", 50)             # many blocks
    rng = random.Random(min_exponent)
    for _ in range(60):
        texts = random_texts(rng, rng.randint(1, 12))
        assert runs_of(texts, min_length, min_exponent) == [brute(t, min_length, min_exponent) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), max_size=4))
def test_any_texts(texts):
    assert runs_of(texts, 2, 2) == [brute(t, 2, 2) for t in texts]


def test_edges():
    assert runs_of([]) == []
    assert runs_of([[], [], [b"a"]]) == [[], [], []]
    assert runs_of([[b"a"] * 5]) == [[]]
    assert runs_of([[b"a"] * 6, [b"a"] * 7]) == [[(0, 6, 1)], [(0, 7, 1)]]           # neighbours stay apart
    long = [b"a", b"b", b"c"] * 20_000
    assert runs_of([long]) == [[(0, 60_000, 3)]]
    assert runs_of([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]                          # squares of every multiple
    fib = [b"a"], [b"a", b"b"]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    assert runs_of([fib[1]], 2, 2) == [brute(fib[1], 2, 2)]


def test_parts_of_the_array():
    rng = random.Random(5)
    texts = random_texts(rng, 6)
    number = {}
    codes = np.array([number.setdefault(w, len(number)) for t in texts for w in t])
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(texts)), sizes)
    order, ranks = word_runs.suffix_order(codes, doc, starts[doc + 1])
    suffix = [(int(doc[i]), codes[i:starts[doc[i] + 1]].tolist()) for i in range(len(codes))]
    assert order.tolist() == sorted(range(len(codes)), key=suffix.__getitem__)
    lcp = word_runs.common_prefixes(order, ranks)
    for j in range(1, len(order)):
        (d, x), (e, y) = suffix[order[j - 1]], suffix[order[j]]
        shared = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert lcp[j] == (shared if d == e else 0)
    with pytest.raises(ValueError):
        word_runs.find_runs(codes, doc, starts, 2, 1)


def plain_words(text):
    return (text or "").encode().split()


def plain_query(doc_id, text):
    words = plain_words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else zlib.crc32(b"")
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    drop = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op13_word_runs(spark, sf).collect()
    assert len(out) == len(texts) and any(r["n_runs"] for r in out)
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == plain_query(r["doc_id"], texts[r["doc_id"]]), r["doc_id"]


def test_rows_that_are_not_plain(spark, tmp_path):
    loop = " ".join(["x", "y"] * 9)
    rows = [(k, " ".join(f"w{j}" for j in range(k))) for k in range(90)]
    rows += [(1000, loop), (1000, loop), (None, loop), (1001, None), (1002, ""), (1003, " \n\t"), (1004, "é \x1f ü z " * 12),
             (1005, "a " * 9 + "b " * 9), (1006, "\n\n" + "q\r\n" * 3000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, words string, g int")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = op13_word_runs(spark, str(tmp_path)).collect()
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out), key=key) == \
        sorted(((d, *plain_query(d, t)) for d, t in rows), key=key)
    assert word_runs.periodic_runs(with_planted_periods(docs.limit(0))).collect() == []
