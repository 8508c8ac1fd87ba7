from __future__ import annotations

import gc
import random
import weakref

import numpy as np

from souk.llm import decontaminate as dc


def brute(text, item):
    w, x = dc.words_of(text), dc.words_of(item)
    if not w or not x:
        return False
    names = {v: k for k, v in enumerate(sorted({*w, *x}))}
    return dc.edit_distance(np.array([names[v] for v in x]), np.array([names[v] for v in w])) <= dc.allowed(len(x))


def slow_distance(a, b):
    best = None
    for i in range(len(b) + 1):
        row = list(range(len(a) + 1))
        best = row[-1] if best is None else min(best, row[-1])
        for j in range(i, len(b)):
            new = [row[0] + 1]
            for k in range(1, len(a) + 1):
                new.append(min(row[k - 1] + (a[k - 1] != b[j]), row[k] + 1, new[-1] + 1))
            row = new
            best = min(best, row[-1])
    return best


def edited(rng, words, n, vocab):
    words = list(words)
    for _ in range(n):
        k, at = rng.random(), rng.randrange(len(words))
        if k < 0.4:
            words[at] = rng.choice(vocab)
        elif k < 0.7:
            words.insert(at, rng.choice(vocab))
        else:
            del words[at]
    return words


def test_edit_distance_against_plain_tables():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 7))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 9))]
        assert dc.edit_distance(np.array(a), np.array(b, dtype=np.int64)) == slow_distance(a, b)


def test_query_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    items = [[rng.choice(vocab) for _ in range(rng.choice((3, 5, 9, 20, 35, 50)))] for _ in range(40)]
    texts: list[str | None] = [None, "", "!!!", " ".join(items[0]), "the the the " * 300]
    for k in range(300):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        it = rng.choice(items)
        body[len(body) // 2:len(body) // 2] = edited(rng, it, rng.randint(0, dc.allowed(len(it)) + 2), vocab) if k % 3 else []
        texts.append(" ".join(body).upper() if k % 5 == 0 else ", ".join(body))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y")], "doc_id long, text string, k1 string")
    bench = spark.createDataFrame([*((k, " ".join(x)) for k, x in enumerate(items)), (99, None), (98, ""), (97, " ".join(items[0]))],
                                  "item_id long, text string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in dc.contaminated(docs, bench).collect()}
    want = {i: {k for k, x in enumerate(items) if brute(t, " ".join(x))} | ({97} if brute(t, " ".join(items[0])) else set())
            for i, t in enumerate(texts)}
    assert all(got[i] <= want[i] for i in want)                      # verified matches only
    hits, found = sum(map(len, want.values())), sum(map(len, got.values()))
    assert hits > 100 and found >= 0.98 * hits, (hits, found)
    blocks = {r["doc_id"]: set(r["item_ids"]) for r in dc.contaminated(docs, bench, max_items=12).collect()}
    assert blocks == got
    kept = dc.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in dc.contaminated(docs, none).collect()] == [False]
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.contaminated(docs.limit(0), items).collect() == []


def test_very_long_item_beside_short_ones(monkeypatch):
    """An item of thousands of words is embedded in bounded parts, with the same results."""
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(900)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (4000, 30, 30, 12, 60)]
    texts = [" ".join(edited(rng, items[0], 200, vocab)), " ".join(rng.choice(vocab) for _ in range(300)), None,
             *(" ".join(["x", "y", *edited(rng, it, 2, vocab), "z"]) for it in items[1:])]
    block = dc.Items(list(range(5)), [" ".join(x) for x in items])
    want = [[0], [], [], [1], [2], [3], [4]]
    assert [sorted(m) for m in block.prepare().matches(texts)] == want
    monkeypatch.setattr(dc, "CELLS", 1_000)                 # one or a few windows a part
    assert [sorted(m) for m in block.prepare().matches(texts)] == want


def test_long_items_at_the_largest_number_of_edits():
    """Exactly floor(n / 5) substitutions or mixed edits, at 50 to 4,000 words: nothing is lost."""
    rng = random.Random(21)
    vocab = [f"w{k}" for k in range(5000)]
    for n, texts_n in ((50, 40), (64, 40), (100, 40), (200, 40), (400, 30), (1000, 25), (2000, 20), (4000, 8)):
        item, texts = [rng.choice(vocab) for _ in range(n)], []
        noise = lambda: [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(texts_n):
            texts.append(" ".join([*noise(), *edited(rng, item, dc.allowed(n), vocab), *noise()]))
        block = dc.Items([0], [" ".join(item)]).prepare()
        got = [m == [0] for m in block.matches(texts)]
        assert sum(got) == len(texts), (n, sum(got), len(texts))
        far = [" ".join(edited(rng, item, 2 * dc.allowed(n), vocab)) for _ in range(3)]
        assert [m == [0] for m in block.matches(far)] == [brute(t, " ".join(item)) for t in far]


def test_one_block_of_items_is_on_the_driver_at_a_time(spark, monkeypatch):
    made, alive, real = [], [], dc.Items.__init__

    def init(self, *args):
        gc.collect()
        alive.append(sum(r() is not None for r in made))
        made.append(weakref.ref(self))
        real(self, *args)

    monkeypatch.setattr(dc.Items, "__init__", init)
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k}") for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x a{k} b{k} c{k} y") for k in range(0, 30, 2)], "doc_id long, text string")
    found = {r["doc_id"]: r["item_ids"] for r in dc.contaminated(docs, items, max_items=10).collect()}
    assert found == {k: [k] for k in range(0, 30, 2)}
    assert len(alive) > 3 and max(alive) == 0, alive
