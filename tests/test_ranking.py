"""Distributed global ranking against Spark's single-partition window."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.functions import ranking as R


def _data(spark, n=5000, nulls=False):
    df = spark.range(n).select(
        F.format_string("k%05d", (F.col("id") * 7919) % n).alias("k"),
        F.when(F.col("id") % 10 == 0, (F.col("id") * 31) % 97).otherwise(F.lit(3))
        .cast("decimal(12,2)").alias("v"),
        ((F.col("id") * 13) % 7).alias("g"))
    if nulls:
        df = df.withColumn("v", F.when(F.col("g") == 0, F.lit(None)).otherwise(F.col("v")))
    return df


@pytest.mark.parametrize("asc", [True, False])
@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("partitions", [1, 7, 32])
def test_equals_builtin_window(spark, asc, nulls, partitions):
    df = _data(spark, nulls=nulls)
    order = [("v", asc), ("k", True)]
    got = R.global_rank(df, order, prefix="g", value="v", partitions=partitions).withColumn("t", R.ntile("g_rn", "g_n", 5))
    w = Window.orderBy(*R.sort_columns(order))
    ref = (df.withColumn("rn", F.row_number().over(w))
           .withColumn("run", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("t5", F.ntile(5).over(w)))
    j = got.join(ref, "k")
    assert j.count() == 5000
    bad = j.filter((F.col("g_rn") != F.col("rn")) | (F.col("t") != F.col("t5"))
                   | ~F.col("g_running").eqNullSafe(F.col("run"))).count()
    assert bad == 0


def test_empty_input(spark):
    assert R.global_rank(_data(spark).limit(0), [("v", True), ("k", True)], prefix="g", value="v").collect() == []


def test_ranges_are_balanced_under_heavy_ties(spark):
    df = _data(spark, n=20000)                     # 90% of rows share one value
    cols = R.sort_columns([("v", True), ("k", True)])
    sizes = [r[1] for r in df.repartitionByRange(16, *cols).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 4 * 20000 / 16


@pytest.mark.parametrize("n", [1, 3, 4, 5, 7, 23, 100])
@pytest.mark.parametrize("k", [5, 10])
def test_ntile_formula(spark, n, k):
    df = spark.range(n).withColumn("rn", F.col("id") + 1).withColumn("n", F.lit(n).cast("bigint"))
    got = df.select(R.ntile("rn", "n", k).alias("a"), F.ntile(k).over(Window.orderBy("id")).alias("b"))
    assert got.filter("a != b").count() == 0
