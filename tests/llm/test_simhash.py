from __future__ import annotations

import random

import xxhash

from souk.llm import simhash
from souk.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, linked):
    out = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(out[a], out[b])
            if out[a] != low or out[b] != low:
                out[a] = out[b] = low
                changed = True
    return out


def test_fingerprints():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "One", "one TWO", "É é Ñ", "a b c", "a b c d\x1fe f",
                 *(" ".join(rng.choice("abcd") * rng.randint(1, 3) for _ in range(rng.randint(1, 80))) for _ in range(60))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_all_pairs_within_three_bits_are_found(spark):
    rng = random.Random(4)
    fps = {0, 2**64 - 1, 1, 7, 15}
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for n in (1, 2, 3, 3, 4, 5):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {(r["a"], r["b"], r["bits"]) for r in
           simhash.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in signed for b in signed
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_asks_are_never_broadcast(spark):
    """An explode counts as its input in the engine's sizes: few fingerprints looked small enough."""
    assert int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) > 0
    fps = spark.createDataFrame([(1 << k,) for k in range(40)], "fp long")
    pairs = simhash.near_fingerprints(fps)
    before = pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 40 * 39 // 2
    pairs.collect()
    for plan in (before, pairs._jdf.queryExecution().executedPlan().toString()):
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_groups_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    texts = [None, "", "x", "X", "a b", "a  B"] + base + base[:5]
    for b in base:
        for _ in range(3):
            w = b.split()
            w[rng.randrange(200)] = "changed"
            texts.append(" ".join(w))
    rows = [(len(texts) - i, t, "f") for i, t in enumerate(texts)] + [(5, "one id on two rows", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    fp = [plain_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if (fp[i] ^ fp[j]).bit_count() <= 3 or rows[i][0] == rows[j][0]]
    comp = plain_components(range(len(rows)), links)
    least = {c: min(rows[i][0] for i in comp if comp[i] == c) for c in set(comp.values())}
    want = sorted((rows[i][0], fp[i] - 2**64 if fp[i] >= 2**63 else fp[i], least[comp[i]]) for i in comp)
    got = sorted((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.simhash_groups(docs).collect())
    assert got == want
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    for n, m in ((60, 30), (60, 90), (200, 199)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 199 else [(i, i + 1) for i in range(199)]
        want = plain_components({x for e in edges for x in e}, edges)
        got = {r["node"]: r["component"] for r in
               components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {k: v for k, v in want.items() if k in got}
        assert all(want[k] == k for k in want if k not in got)          # only self-loops are left out
