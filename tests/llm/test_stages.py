"""What a document is in the pipeline: id types, repeated ids, null ids, clashing columns."""

from __future__ import annotations

import random

import pytest

from souk.llm import simhash, stages


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    return [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_documents_under_one_id(spark, kind):
    """Different texts under one id are different documents; copies leave the least id."""
    t = corpus()
    name = (lambda k: k) if kind == "long" else (lambda k: None if k is None else f"d{k}")
    rows = [(1, t[0], "b"), (1, t[1], "a"), (1, t[0], "a"), (2, t[1], "x"), (3, t[2], "x"), (None, t[2], "x"),
            (None, t[3], "z"), (None, t[3], "y"), (None, t[4], "x"), (4, t[5], None), (4, t[5], None)]
    docs = spark.createDataFrame([(name(k), x, e) for k, x, e in rows], f"doc_id {kind}, text string, __id string").repartition(3)
    out = stages.near_duplicates(spark, docs, "")
    assert out.schema == docs.schema
    want = [(1, t[0], "a"), (1, t[1], "a"), (3, t[2], "x"), (None, t[3], "y"), (None, t[4], "x"), (4, t[5], None)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(name(k), x, e) for k, x, e in want], key=repr)
    only = stages.near_duplicates(spark, docs.select("text", "doc_id"), "")
    assert only.columns == ["text", "doc_id"] and only.count() == len(want)
    assert stages.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_near_duplicates_broadcast_no_asks(spark, monkeypatch):
    """The exploded cells of the fingerprints look small to the engine, whatever their number."""
    plans, write = {}, simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, label: (
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1])
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(corpus())], "doc_id long, text string, lang string")
    assert stages.near_duplicates(spark, docs, "").count() == 6
    assert "Generate explode" in plans["simhash-links"] and "BroadcastExchange" not in plans["simhash-links"]


def test_columns_named_like_helpers(spark, tmp_path):
    t = corpus()
    names = ["__h", "__s", "__guess", "__id", "key", "guess", "c1", "fp", "row", "lang"]
    schema = "doc_id long, " + ", ".join(f"{n} string" for n in names) + ", text string"
    rows = [(k, *[f"{n}{k}" for n in names[:-1]], "en", x) for k, x in enumerate([*t, t[0] + " " + t[1]])]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, t[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for step in (stages.language, stages.near_duplicates, stages.repeated_passages, stages.benchmark_leaks):
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert got and all(r[n] == f"{n}{k}" for k, r in got.items() for n in names[:-1]), step.__name__
        assert (2 in got) == (step is not stages.benchmark_leaks)
        if step is stages.repeated_passages:          # documents 0, 1 and 6 share their whole text and go
            assert set(got) == {2, 3, 4, 5}
        docs = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out
