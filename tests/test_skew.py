"""Salted join equals the plain join and spreads a hot key."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions.skew import salted_join


def test_salted_join_equals_plain_join_and_spreads_hot_key(spark):
    # key 0 holds a third of the rows
    many = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1).alias("k"),
        F.col("id").cast("string").alias("row_id"))
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("payload", F.col("k") * 10)
    got = salted_join(many, one, "k", count_col="n", salt_by="row_id", shares=30)
    few = salted_join(many, one, "k", count_col="n", salt_by="row_id", shares=3000)
    assert few.count() == 30000
    plain = many.join(one, "k", "inner")
    assert got.count() == plain.count() == 30000
    assert got.select("k", "row_id", "n", "payload").exceptAll(plain.select("k", "row_id", "n", "payload")).count() == 0
    # the hot key (10,000 rows) is split into ceil(10000 / (30000 / 30)) = 10 salts
    hot = many.filter("k = 0").select((F.pmod(F.xxhash64("row_id"), F.lit(10))).alias("s")).groupBy("s").count()
    sizes = [r[1] for r in hot.collect()]
    assert len(sizes) == 10 and max(sizes) < 2000
