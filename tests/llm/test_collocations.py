from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from souk.llm import collocations
from souk.llm.queries import op12_collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, max_words, min_count, top, percent):
    """rows: (text, lang). All phrases counted one by one."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = [w.decode() for w in re.findall(rb"[^\x20\x09]+", piece)]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = []
    for (lang, *words), a in cands.items():
        if any(q[0] == lang and len(q) > len(words) + 1 and 100 * b >= percent * a
               and any(list(q[s:s + len(words)]) == words for s in range(1, len(q) - len(words) + 1)) for q, b in cands.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k,
                              f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    made, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            made.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(made)


def corpus(rng, count):
    vocab = ["the", "The", "of", "new", "york", "city", "é", "z", "Ünder"]
    rows = []
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(25)):
            words.append(rng.choice(vocab))
            if rng.random() < 0.3:
                words += ["new", "york", "city", "hall"][:rng.randint(1, 4)]
            if rng.random() < 0.2:
                words[-1] += rng.choice([".", ",", "!", "\n", "\r\n", ";", "\x0b", ":"])
        rows.append((rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize(("broadcast", "max_words", "min_count", "top", "percent"),
                         [(250_000, 5, 12, 2000, 100), (0, 5, 12, 2000, 100), (250_000, 3, 5, 7, 70)])
def test_against_brute_force(spark, monkeypatch, broadcast, max_words, min_count, top, percent):
    monkeypatch.setattr(collocations, "BROADCAST_PHRASES", broadcast)       # 0: every join shuffles
    rows = corpus(random.Random(max_words), 150)
    rows += rows[:40] * 3 + [(None, "en"), ("", "en"), (" ., !", None), ("new york " * 300, "fr"), ("a a a a a a " * 9, "fr")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, g1 int, piece int").repartition(5)
    out = collocations.collocations(docs, max_words, min_count, top, percent)
    made = sorted(tuple(r) for r in out.collect())
    assert out.columns == COLUMNS and made == brute(rows, max_words, min_count, top, percent) and len(made) > 10
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("souk_setm")]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts as from a very large corpus: a product above 2^64, the quotient exact."""
    a, l, r, n = 4_000_000_007, 5_000_000_029, 4_000_000_009, 9_000_000_000_001
    phrases = [spark.createDataFrame([], "lang string, phrase string, f long, g long, g1 long, g2 long, last string, heads array<long>, tails array<long>"),
               spark.createDataFrame([("en", "x y", a, 1, 1, 2, "y", [l], [r])],
                                     "lang string, phrase string, f long, g long, g1 long, g2 long, last string, heads array<long>, tails array<long>")]
    totals = spark.createDataFrame([("en", n)], "lang string, total long").selectExpr("lang", "cast(total as decimal(16,0)) total")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (phrases, totals))
    monkeypatch.setattr(collocations, "drop_staged", lambda *_: None)
    out = collocations.collocations(spark.range(0), 2).collect()
    assert 1000 * a * n > 2 ** 64 and l * r > 2 ** 63
    assert [r_["score"] for r_ in out] == [1000 * a * n // (l * r)]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    theirs = sorted(con.execute(f"SELECT {','.join(COLUMNS)} FROM ({collocations.SQL})").fetchall())
    ours = sorted(tuple(r[c] for c in COLUMNS) for r in op12_collocations(spark, "/root/testdata/sf0.001").collect())
    assert ours == theirs and ours


def test_occurrences_are_not_shuffled(spark, monkeypatch):
    """However many phrases are frequent, a relation is written from buckets as they lie."""
    monkeypatch.setattr(collocations, "BROADCAST_PHRASES", 0)
    read, write = [], collocations.Relations.write

    def watched(self, df, label, *rest):
        if label != "pieces":
            plan = df._jdf.queryExecution().executedPlan().toString()
            scans = [k for k, line in enumerate(plan.splitlines()) if "souk_setm_" in line]
            moved = [k for k, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line and any(
                s > k and plan.splitlines()[s].index("Scan") > line.index("Exchange") for s in scans[:1])]
            read.append((label, len(scans) > 0, moved, plan.count("SortMergeJoin") + plan.count("Generate")))
        return write(self, df, label, *rest)

    monkeypatch.setattr(collocations.Relations, "write", watched)
    rows = corpus(random.Random(2), 60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    made = sorted(tuple(r) for r in collocations.collocations(docs, 4, 4, 50, 100).collect())
    assert made == brute(rows, 4, 4, 50, 100)
    assert [r[:3] for r in read] == [(f"r{k}", True, []) for k in (1, 2, 3)]


def test_numbers_beyond_31_bits():
    """Phrase numbers of any size meet in one key; sums and look-ups of few and of many keys."""
    a, b = np.array([5, 1 << 40, 5, 7]), np.array([1 << 50, 3, 1 << 50, 1 << 40])
    x, y = collocations.small(a, b)
    assert x.max() < 1 << 31 and x[0] == x[2] and y[3] == x[1] and len({*x, *y}) == len({*a, *b})
    for size in (8, 1 << 60):
        key, f = collocations.sums(np.array([7, 2, 7, 0]), np.array([1, 10, 100, 1000]), size)
        assert (key.tolist(), f.tolist()) == ([0, 2, 7], [1000, 10, 101])
        got = collocations.looked_up(np.array([7, 2, 7, 0]), np.array([7, 0]), np.array([70, 90]), size)
        assert got.tolist() == [70, -1, 70, 90]
