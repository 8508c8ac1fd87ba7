from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from souk.llm import sharding


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_feistel_is_a_permutation_with_inverse(n, seed):
    p = sharding.Feistel(n, seed)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert (p.inverse(out) == np.arange(n)).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_shards(spark, parts):
    texts = [None, "", "a", "é", "a"] * 11
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, "same", "x", 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").repartition(parts)
    out = sharding.shard_documents(docs, 8).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == want
    assert sorted(r["row_no"] for r in out) == list(range(len(rows)))
    for r in out[:10]:
        assert sharding.locate(r["row_no"], len(rows), 8) == (r["shard"], r["slot"])
        assert sharding.row_at(r["shard"], r["slot"], len(rows), 8) == r["row_no"]
    again = sharding.shard_documents(docs.repartition(3), 8).collect()     # reproducible
    key = lambda x: sorted((r["doc_id"] or -1, r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in x)
    assert key(out) == key(again)


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
