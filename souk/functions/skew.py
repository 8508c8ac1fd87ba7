"""Joining many rows per key to one row per key when a few keys are huge.

A sort-merge join sends every row of a key to one task. When the join is
followed by an aggregate on the same key, AQE's skew-join split would need an
extra shuffle and is skipped, so a person holding a third of all orders would
be one task's work. Here such keys are salted explicitly:

* the one-row-per-key side already carries each key's row count (it is the
  aggregate that produced it), so finding hot keys costs no extra pass;
* a key is hot if it holds more than ``1 / SHARES`` of all rows, so there are
  fewer than ``SHARES`` hot keys at any size: the broadcast list needs no limit;
* a hot key's rows are spread over ``ceil(count / target)`` salts by a hash of
  a row id, and its single row on the other side is replicated once per salt.
Every row still meets its key's row exactly once, so the result equals the
plain inner join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 2_000              # a key above 1 / SHARES of all rows is split


def salted_join(many: DataFrame, one: DataFrame, key: str, *, count_col: str, salt_by: str,
                shares: int = SHARES) -> DataFrame:
    """Inner join of ``many`` with ``one`` (unique ``key``, ``count_col`` =
    rows of the key in ``many``), spreading hot keys over several tasks."""
    target = F.greatest(F.lit(1.0), one.agg(F.sum(count_col) / F.lit(float(shares))).scalar())
    hot = (one.filter(F.col(count_col) > target)
           .select(key, F.ceil(F.col(count_col) / target).cast("bigint").alias("__salts")))
    hot = F.broadcast(hot)                        # fewer than ``shares`` rows
    m = (many.join(hot, key, "left")
         .withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("__salts")), F.lit(0)))
         .drop("__salts"))
    o = (one.join(hot, key, "left")
         .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
         .drop("__salts"))
    return m.join(o, [key, "__salt"], "inner").drop("__salt")
