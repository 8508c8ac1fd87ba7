from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from souk.llm import embed_graph, pieces
from test_simhash import plain_components, plain_fingerprint


def brute(rows, threshold=0.93):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v)
          and any(x != 0 for x in v)]
    links = []
    for a in ok:
        for b in ok:
            if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((a, b))
    return links


def test_links_and_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(260):
        rows.append((k, rng.standard_normal(24).tolist(), int(k % 3)))
    for k in range(60):                                            # near copies, chains and a dense group
        base = np.array(rows[k % 12][1])
        rows.append((300 + k, (base + rng.standard_normal(24) * 0.12).tolist(), rows[k % 12][2]))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, None, 0), (504, [], 0), (505, [0.0] * 24, 0),
             (506, [None] + [1.0] * 23, 0), (507, [float("nan")] + [1.0] * 23, 0), (508, rows[1][1], None), (509, [1.0, 2.0], 1),
             (510, (2 * np.array(rows[0][1])).tolist(), 0)]
    monkeypatch.setattr(embed_graph, "SHARD", 60)                 # several shards a label
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    out = {r["vec_id"]: r for r in embed_graph.embedding_groups(docs).collect()}
    links = brute(rows)
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    comp = plain_components(range(len(rows)), links)
    assert len(out) == len(rows) and len(links) > 100
    found = sum(out[rows[k][0]]["n_links"] for k in range(len(rows)))
    assert all(out[rows[k][0]]["n_links"] <= degree[k] for k in range(len(rows)))
    assert found >= 0.9 * sum(degree)
    if found == sum(degree):
        assert all(out[rows[k][0]]["component_id"] == rows[comp[k]][0] for k in range(len(rows)))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.values())
    assert embed_graph.embedding_groups(docs.limit(0)).collect() == []


def test_dense_group_in_blocks(spark, monkeypatch):
    """A dense group larger than a shard may be: blocks, every link counted once."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    rows = [(k, (centre + rng.standard_normal(16) * 0.15).tolist(), 1) for k in range(240)]
    rows += [(300 + k, rng.standard_normal(16).tolist(), 1) for k in range(150)]
    rows += [(500 + k, rows[k][1], 1) for k in range(20)]                       # copies inside the group
    monkeypatch.setattr(embed_graph, "SHARD", 40)
    monkeypatch.setattr(embed_graph, "SHARD_MAX", 80)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out = {r["vec_id"]: r for r in embed_graph.embedding_groups(docs).collect()}
    links = brute(rows)
    degree = dict.fromkeys((r[0] for r in rows), 0)
    for a, b in links:
        degree[rows[a][0]] += 1
        degree[rows[b][0]] += 1
    assert len(links) > 10_000
    assert all(out[v]["n_links"] <= n for v, n in degree.items())
    assert sum(r["n_links"] for r in out.values()) >= 0.98 * sum(degree.values())
    comp = plain_components(range(len(rows)), links)
    assert sum(out[rows[k][0]]["component_id"] == rows[comp[k]][0] for k in range(len(rows))) >= 0.99 * len(rows)


@pytest.mark.parametrize("most", [1000, 100])
def test_elongated_group_is_not_parted_without_overlap(spark, monkeypatch, most):
    """A dense arc of 40 degrees, larger than a shard: two centroids stand apart on it.
    It stays one shard, or (above SHARD_MAX) becomes blocks; no link across a cut is lost."""
    rng = np.random.default_rng(6)
    angle = np.radians(rng.random(320) * 40)
    arc = np.zeros((320, 16))
    arc[:, 0], arc[:, 1] = np.cos(angle), np.sin(angle)
    arc += rng.standard_normal(arc.shape) * 0.005
    rows = [(k, v.tolist(), 1) for k, v in enumerate(arc)]
    monkeypatch.setattr(embed_graph, "SHARD", 60)
    monkeypatch.setattr(embed_graph, "SHARD_MAX", most)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    _, classes = embed_graph.link_vectors(docs)
    found, links = sum(r["n_links"] for r in classes.collect()), len(brute(rows))
    assert links > 10_000 and 0.98 * 2 * links <= found <= 2 * links, (found, links)


def test_short_search_is_seen_and_made_whole(spark, monkeypatch):
    """A search that finds exact copies only: copies do not hide it from the audit, nor do
    many nodes without a link, and the labels it fails are compared exactly."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):                                            # pairs with many copies, and a chain
        base = rng.standard_normal(24)
        rows += [(100 * k + c, base.tolist(), 1) for c in range(30)]
        rows.append((100 * k + 50, (base + rng.standard_normal(24) * 0.1).tolist(), 1))
    rows += [(5000 + k, (np.array(rows[0][1]) + 0.15 * k).tolist(), 1) for k in range(1, 8)]
    rows += [(6000 + k, rng.standard_normal(24).tolist(), 2) for k in range(900)]
    real = embed_graph.link_vectors

    def copies_only(rows, *more):
        nodes, classes = real(rows, *more)
        alone = nodes.select("node", "name", (F.col("copies") - 1).alias("n_links"), F.lit(0).cast("bigint").alias("n_others"),
                             F.col("node").alias("root"))
        return nodes, alone

    monkeypatch.setattr(embed_graph, "link_vectors", copies_only)
    monkeypatch.setattr(embed_graph, "SHARD", 30)                  # several blocks
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out = {r["vec_id"]: r for r in embed_graph.embedding_groups(docs).collect()}
    links = brute(rows)
    degree = dict.fromkeys((r[0] for r in rows), 0)
    for a, b in links:
        degree[rows[a][0]] += 1
        degree[rows[b][0]] += 1
    comp = plain_components(range(len(rows)), links)
    assert {v: r["n_links"] for v, r in out.items()} == degree
    assert all(out[rows[k][0]]["component_id"] == rows[comp[k]][0] for k in range(len(rows)))


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage's decisions against brute force, on a small corpus."""
    from test_decontaminate import brute as leaks
    from test_repeats import brute as repeated

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, items = say(70), [say(30) for _ in range(3)]
    texts = [say(rng.randint(30, 120)) for _ in range(40)]
    texts[3] += " " + passage
    texts[4] = passage + " " + texts[4]
    texts[5] += " " + items[0]
    texts[6] += " " + items[1].upper()
    texts += [texts[0], texts[1], None, "", "1234 !!", passage]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {k: t for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    fp = {k: plain_fingerprint(t) for k, t in left.items()}
    comp = plain_components(left, [(a, b) for a in left for b in left if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    left = {k: t for k, t in left.items() if comp[k] == k}
    assert len(left) == 41
    cut = {}
    for k, t in left.items():
        data, others = t.encode(), [x.encode() for j, x in left.items() if j != k]
        gone = bytearray(len(data))
        for i in range(len(data) - 199):
            s = data[i:i + 200]
            if any(s in x for x in others) or data.find(s) != i or data.find(s, i + 1) >= 0:
                gone[i:i + 200] = b"\1" * 200
        cut[k] = bytes(x for x, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    assert [r[1:3] for r in repeated(list(left.values()), 200)] and any(cut[k] != left[k] for k in cut)
    left = {k: t for k, t in cut.items() if t.strip()}
    left = {k: t for k, t in left.items() if not any(leaks(t, i) for i in items)}
    assert set(out) == set(left) and 5 not in out and 6 not in out and 0 in out
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for k, t in left.items():
        ids = library.encode(t)
        assert list(out[k]["ids"]) == ids and out[k]["n_tokens"] == len(ids)
        assert out[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_has_one_query_per_operator():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries() and set(oracle_sql()) <= set(queries())
