"""Exact distinct counts that can be merged: bitmaps over dense numbers of the keys.

``COUNT(DISTINCT key)`` cannot be added up over months, states or loads; the union of
bitmaps can. Every key gets a number once (``number_keys``; later loads only add keys), a
group's keys are bits at their numbers, and a union is an OR of bitmaps, whatever the
number of times a key was seen. A bitmap covers 32,768 numbers (4 KB), so a group is a
row per range of numbers that it has keys in, never one large value.

A bitmap costs 4 KB however few bits it has, so none is made before the rows of its range
are together: the rows (group, number) are dealt by range first and each range is
built in one task, which then holds at most 32,768 keys a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.sources.staging import stage


def number_keys(keys: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, number): ``known`` and, numbered from its end without a gap, the other non-null
    keys of ``keys``. Numbers never change once given; they are written before use,
    so a task that runs again cannot deal them differently."""
    new = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    start = F.lit(0)
    if known is not None:
        new = new.join(known.select(key), key, "left_anti")
        start = F.lit(known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0])
    at = F.monotonically_increasing_id()
    placed = stage(new.withColumn("at", at).select(
        F.col(key).alias("key"), F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "keys")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = placed.join(F.broadcast(offsets), "part").select(
        F.col("key").alias(key), (start + F.col("before") + F.col("at")).cast("bigint").alias("number"))
    return stage(out if known is None else known.select(key, "number").unionAll(out), "key-numbers")


def build_bitmaps(rows: DataFrame, groups: list[str], number: str = "number") -> DataFrame:
    """(groups, bucket, bits) from rows of groups and numbers; repeated rows do not matter."""
    spark = rows.sparkSession
    # Ranges are dealt first (see above); the aggregate by (range, groups) needs no other exchange.
    dealt = (rows.select(*groups, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "bucket"))
    return dealt.groupBy("bucket", *groups).agg(F.bitmap_construct_agg("bit").alias("bits")).select(*groups, "bucket", "bits")


def merge_bitmaps(*loads: DataFrame, groups: list[str]) -> DataFrame:
    """The bitmaps of all loads together."""
    both = reduce(DataFrame.unionByName, loads)
    return both.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def roll_up(bitmaps: DataFrame, **groups: Column) -> DataFrame:
    """Bitmaps of coarser groups, from those of finer ones alone."""
    named = bitmaps.select(*[c.alias(n) for n, c in groups.items()], "bucket", "bits")
    return merge_bitmaps(named, groups=list(groups))


def distinct_counts(bitmaps: DataFrame, groups: list[str], name: str) -> DataFrame:
    """groups and the number of different keys of each."""
    return bitmaps.groupBy(*groups).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(name))
