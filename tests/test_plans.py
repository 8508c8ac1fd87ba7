"""Plan shape of the registered queries."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.plans.inspect import cross_products, physical_plan, unpartitioned_windows, without_initial_plans
from souk.plans.registry import QUERIES

SF = os.environ.get("SOUK_TEST_SF", "/root/testdata/sf0.001")


def test_unpartitioned_windows_are_found(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    one = df.withColumn("n", F.row_number().over(Window.orderBy("id")))
    whole = df.withColumn("n", F.sum("id").over(Window.partitionBy()))
    many = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert len(unpartitioned_windows(physical_plan(one))) >= 1
    assert len(unpartitioned_windows(physical_plan(whole))) >= 1
    assert unpartitioned_windows(physical_plan(many)) == []


def test_plan_is_the_executed_one(spark):
    assert "isFinalPlan=true" in physical_plan(spark.range(100).groupBy(F.col("id") % 3).count())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    assert cross_products(physical_plan(QUERIES[name](spark, SF))) == []


@pytest.mark.parametrize("name", ["rfm_segments", "seller_risk", "seller_pareto", "revenue_concentration"])
def test_rankings_keep_rows_partitioned(spark, name):
    plan = physical_plan(QUERIES[name](spark, SF))
    for line in unpartitioned_windows(plan):
        assert "__part" in line, line             # one row per range partition
    assert "64 KB" not in plan


def test_monthly_kpi_single_partition_only_over_months(spark):
    windows = unpartitioned_windows(physical_plan(QUERIES["monthly_kpi"](spark, SF)))
    assert windows and all("cohort_month" in line for line in windows)


def test_repeat_rate_cuts_each_person_to_two_rows_before_the_shuffle(spark):
    plan = physical_plan(QUERIES["repeat_rate_gap"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_initial_plans_are_left_out(spark):
    """Of a query and of its subqueries; what stands behind a subquery stays."""
    t = spark.range(1000).withColumn("k", F.col("id") % 7)
    top = t.groupBy("k").count().agg(F.max("count")).scalar()
    df = t.groupBy("k").count().filter(F.col("count") >= top)
    plan = physical_plan(df)
    raw = df._jdf.queryExecution().executedPlan().toString()
    assert raw.count("== Initial Plan ==") >= 1 and "Initial Plan" not in plan
    assert 1 <= plan.count("== Final Plan ==") <= raw.count("== Final Plan ==")   # an initial plan prints its subqueries too
    assert plan.splitlines()[0] == raw.splitlines()[0]
    text = "A\n+- == Final Plan ==\n   B\n   :- Sub\n   :  +- == Initial Plan ==\n   :     X\n   :     +- Y\n   +- C\n+- == Initial Plan ==\n   Z"
    assert without_initial_plans(text).splitlines() == ["A", "+- == Final Plan ==", "   B", "   :- Sub", "   +- C"]
