"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python code runs on Arrow batches of at most this many rows; whole texts of
#: a batch are in memory at once, in the worker and (pooled, off the heap) in the
#: executor's JVM, so the count is kept low.
BATCH_ROWS = 400

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that Python
    tasks can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="souk-ship-"), "souk_package.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(out)
    _SHIPPED[sc.applicationId] = out


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of one Arrow batch (never raises a lower setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_HELD: dict[str, object] = {}


def held(key: str, make):
    """What a Python worker keeps between tasks (automata, finished words). A worker
    serves one operator after the other: only the last one's state stays."""
    if key not in _HELD:
        import pyarrow as pa

        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]
