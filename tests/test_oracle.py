"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from souk.plans.registry import QUERIES

SF = os.environ.get("SOUK_TEST_SF", "/root/testdata/sf0.001")
VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{SF}/{v}.parquet')")
    return con


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, Decimal):
            return float(v)
        if isinstance(v, float) and math.isnan(v):
            return "NaN"
        return v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns[0] == "cohort_month"
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _canon(s_rows, sdf.columns) == _canon(d_rows, d_cols)


@pytest.mark.parametrize("shares", [1, 10**9])
def test_cohorts_with_and_without_salting(spark, duck, shares):
    from souk.operators import cohorts
    from souk.plans import registry as R
    olm = R._olm(R._tables(spark, SF), reviews=False)
    sdf = cohorts.cohort_retention(olm, shares=shares)     # 10**9: every person with two orders is salted
    res = duck.execute(oracle_sql()["cohort_retention"])
    d_cols = [d[0] for d in res.description]
    assert _canon([tuple(r) for r in sdf.collect()], sdf.columns) == _canon(res.fetchall(), d_cols)
