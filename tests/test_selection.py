"""Exact selection of cut rows against a plain sort."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.functions import selection
from souk.functions.selection import Share, Tiles, after, cut_rows, tile, tile_ends


def ordered(rows, ascending):
    """NULL is the smallest value; ids go up in either order."""
    return sorted(rows, key=lambda r: ((r[1] is not None) if ascending else (r[1] is None),
                                       0 if r[1] is None else (r[1] if ascending else -r[1]), r[0].encode()))


def tables():
    rng = random.Random(7)
    yield "spread", [(f"id{k:07d}", Decimal(rng.randrange(10**9)) / 100) for k in range(3000)]
    yield "heavy tail", [(str(k), Decimal(int(rng.paretovariate(0.4) * 100)) / 100) for k in range(3000)]
    yield "one value", [(f"{k % 7}-{k}", Decimal(5)) for k in range(2500)]
    yield "long common prefix", [(f"customer/with/a/long/prefix/{k}", Decimal(k % 3)) for k in range(2500)]
    yield "nulls", [(str(k), None if k % 2 else Decimal(k % 11)) for k in range(2600)]
    yield "all null", [(str(k), None) for k in range(1200)]
    yield "few", [("b", Decimal(1)), ("a", Decimal(1)), ("é", None)]
    yield "zero bytes", [("x" + "\0" * k, Decimal(1)) for k in range(40)]
    yield "empty", []


@pytest.mark.parametrize(("name", "rows"), list(tables()), ids=lambda x: x if isinstance(x, str) else "")
def test_cuts_and_labels(spark, monkeypatch, name, rows):
    monkeypatch.setattr(selection, "LEAF", 20)
    monkeypatch.setattr(selection, "BINS", 64)
    df = spark.createDataFrame(rows, "id string, v decimal(20,2)").repartition(4).cache()
    specs = [Tiles("v", 5, True), Tiles("v", 5, False), Tiles("v", 10, True), Share("v", Decimal("0.8"))]
    cuts = cut_rows(df, "id", specs)
    for spec, got in zip(specs[:3], cuts[:3], strict=True):
        order = ordered(rows, spec.ascending)
        want = [order[p - 1] if p else None for p in tile_ends(len(rows), spec.k)]
        assert [c and (c.id, c.value) for c in got] == want
        assert [c and c.place for c in got] == [p or None for p in tile_ends(len(rows), spec.k)]
        labels = {r.id: r.t for r in df.select("id", tile("v", "id", spec.ascending, got).alias("t")).collect()}
        w = Window.orderBy(F.col("v").asc_nulls_first() if spec.ascending else F.col("v").desc_nulls_last(), "id")
        assert labels == {r.id: r.t for r in df.select("id", F.ntile(spec.k).over(w).alias("t")).collect()}
    total, running, place = sum(r[1] or 0 for r in rows), Decimal(0), None
    for k, (i, v) in enumerate(ordered(rows, False)):
        running += v or 0
        if v is not None and running >= total * Decimal("0.8"):
            place = (i, v, k + 1)
            break
    got = cuts[3][0]
    assert (got and (got.id, got.value, got.place)) == place
    if got:
        assert df.filter(~after("v", "id", False, got)).count() == got.place


def test_scans_follow_digits_not_rows(spark, monkeypatch):
    """Every scan returns bounded counts; a heavy value does not bring its rows."""
    rows = [(str(k), Decimal(1 if k % 3 else k)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "id string, v decimal(20,2)").cache()
    seen = []
    plain = selection._counts
    monkeypatch.setattr(selection, "_counts", lambda *a: seen.append(out := plain(*a)) or out)
    (cuts,) = cut_rows(df, "id", [Tiles("v", 5)])
    order = ordered(rows, True)
    assert [(c.id, c.value) for c in cuts] == [order[p - 1] for p in tile_ends(len(rows), 5)]
    assert len(seen) <= 8 and all(len(b) <= selection.BINS for out in seen for b in out.values())


def test_repeated_ids_are_refused(spark):
    df = spark.createDataFrame([("same", Decimal(1))] * 2500, "id string, v decimal(20,2)")
    with pytest.raises(ValueError, match="unique"):
        cut_rows(df, "id", [Tiles("v", 5)])


def test_no_row_is_range_partitioned(spark):
    from souk.plans.registry import QUERIES

    for name in ("rfm_segments", "revenue_concentration", "seller_pareto"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
