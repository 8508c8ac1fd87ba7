"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global number 0..N-1 in the order (doc_id, size, crc32,
hash of the text); a keyed Feistel network permutes 0..4^h-1, and cycle walking
(applying it again while the value lies outside 0..N-1) restricts it to a
permutation of 0..N-1. Position ``p`` goes to shard ``p mod S``, slot ``p div S``,
so shard counts differ by at most one (law ``rows``), slots have no gaps, and
shard and slot of a row can be computed from its number alone -- and, with
:meth:`Feistel.inverse`, the row number from shard and slot.

Row numbers need no single-task sort: narrow rows (no text) are range
partitioned and sorted, numbered inside their partition, staged once (so the
numbering cannot change when a task is run again), and the per-partition counts
(one row per partition) are prefix-summed and joined back.

Cases: a null text has size 16 and crc 0 (as the empty text); null or repeated
ids are ordinary values (rows equal in all order columns are interchangeable);
an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import partitions, ship
from souk.sources.staging import stage

ROW_OVERHEAD = 16
ROUNDS = 6


class Feistel:
    """A keyed permutation of 0..n-1 and its inverse, on numpy arrays."""

    def __init__(self, n: int, seed: int = 20240901, rounds: int = ROUNDS):
        self.n = int(n)
        self.half = max(1, ((max(self.n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        state, self.keys = np.uint64(seed), []
        for _ in range(rounds):
            with np.errstate(over="ignore"):
                state = self._mix(state + np.uint64(0x9E3779B97F4A7C15))
            self.keys.append(state)

    @staticmethod
    def _mix(x):
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

    def _round(self, half: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self._mix(half + key) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def _once_back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._round(left, key), left
        return (left << np.uint64(self.half)) | right

    def _walk(self, x, step) -> np.ndarray:
        x = step(np.asarray(x, dtype=np.uint64))
        while (out := x >= np.uint64(self.n)).any():      # a cycle always comes back below n
            x[out] = step(x[out])
        return x.astype(np.int64)

    def forward(self, rows) -> np.ndarray:
        return self._walk(rows, self._once)

    def inverse(self, positions) -> np.ndarray:
        return self._walk(positions, self._once_back)


def number_rows(df: DataFrame, order: list[str], label: str = "rows") -> tuple[DataFrame, int]:
    """``df`` with a global 0-based ``row_no`` in ``order``, and the row count."""
    spark = df.sparkSession
    n_parts = partitions(spark)
    placed = (df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
              .withColumn("__id", F.monotonically_increasing_id()))
    placed = stage(placed.select(
        "*", F.shiftright("__id", 33).alias("__part"),
        F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).drop("__id"), label)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition of the range exchange: bounded by the session's partition count.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    total = placed.count()
    out = (placed.join(F.broadcast(offsets), "__part")
           .withColumn("row_no", (F.col("__before") + F.col("__at")).cast("bigint")))
    return out.drop("__part", "__at", "__before"), total


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20240901) -> DataFrame:
    """(doc_id, size, text_crc32, row_no, shard, slot): every row in exactly one shard."""
    ship(docs.sparkSession)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(data).cast("bigint") + F.lit(ROW_OVERHEAD)).alias("size"),
        F.crc32(data).cast("bigint").alias("text_crc32"),
        F.xxhash64(data).alias("__hash"))
    numbered, total = number_rows(narrow, ["doc_id", "size", "text_crc32", "__hash"], "shard-rows")
    perm = Feistel(total, seed)

    @F.pandas_udf("bigint")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(perm.forward(rows.to_numpy()))

    placed = numbered.withColumn("__pos", position("row_no"))
    return placed.select("doc_id", "size", "text_crc32", "row_no",
                         F.pmod("__pos", F.lit(shards)).cast("int").alias("shard"),
                         F.floor(F.col("__pos") / F.lit(shards)).cast("bigint").alias("slot"))


def locate(row_no: int, total: int, shards: int = 40, seed: int = 20240901) -> tuple[int, int]:
    """Shard and slot of one row number, without reading anything."""
    p = int(Feistel(total, seed).forward(np.array([row_no]))[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, total: int, shards: int = 40, seed: int = 20240901) -> int:
    """The row number in a slot of a shard."""
    return int(Feistel(total, seed).inverse(np.array([slot * shards + shard]))[0])
