"""Bitmaps over dense key numbers equal COUNT DISTINCT, over groups, roll-ups and loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions.bitmaps import build_bitmaps, distinct_counts, merge_bitmaps, number_keys, roll_up


def load(spark, first, last):
    """Keys k0.. of overlapping loads, key k0 on a third of all rows, some null keys."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(0)).otherwise(n % 70_000)
    return spark.range(first, last).select(
        F.when(n % 1000 != 7, F.concat(F.lit("k"), key)).alias("k"), (n % 5).cast("string").alias("g"))


def test_numbers_are_dense_and_never_change(spark):
    one, two = load(spark, 0, 40_000), load(spark, 30_000, 120_000)
    a = number_keys(one, "k")
    b = number_keys(two, "k", a)
    assert number_keys(one, "k", b).exceptAll(b).count() == 0
    for got, keys in ((a, one), (b, one.unionAll(two))):
        n = keys.filter("k is not null").select("k").distinct().count()
        row = got.agg(F.count("number"), F.countDistinct("k"), F.countDistinct("number"), F.min("number"), F.max("number")).first()
        assert tuple(row) == (n, n, n, 0, n - 1)
    assert a.exceptAll(b).count() == 0
    assert number_keys(one.limit(0), "k").count() == 0 and number_keys(one, "k", number_keys(one.limit(0), "k")).count() == a.count()


def test_counts_of_loads_and_roll_ups(spark):
    one, two = load(spark, 0, 40_000), load(spark, 30_000, 120_000)
    numbers = number_keys(two, "k", number_keys(one, "k"))
    bits = [build_bitmaps(x.join(numbers, "k"), ["g"]) for x in (one, two, one)]       # a load that came twice
    merged = merge_bitmaps(*bits, groups=["g"])
    assert merged.agg(F.max("bucket")).first()[0] >= 2                                 # several ranges of numbers
    rows = one.unionAll(two)
    want = {r.g: r.n for r in rows.groupBy("g").agg(F.countDistinct("k").alias("n")).collect()}
    assert {r.g: r.n for r in distinct_counts(merged, ["g"], "n").collect()} == want
    whole = distinct_counts(roll_up(merged, g=F.lit("all")), ["g"], "n").collect()
    assert [tuple(r) for r in whole] == [("all", rows.select(F.countDistinct("k")).first()[0])]
    assert build_bitmaps(one.limit(0).join(numbers, "k"), ["g"]).count() == 0


def test_one_exchange_before_the_bitmaps(spark):
    """Ranges are dealt before any bitmap is made: no partial bitmaps are shuffled."""
    numbers = number_keys(load(spark, 0, 5_000), "k")
    plan = build_bitmaps(numbers.withColumn("g", F.lit("x")), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("bitmap_construct_agg") < plan.index("Exchange")
