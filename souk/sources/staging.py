"""Materialising an intermediate result in the shared checkpoint folder.

Used where a result is read by several jobs: it is computed once, written as
Parquet under the folder the cluster names in ``spark.checkpoint.dir`` and read
back, which also cuts the lineage, so a lost executor re-reads files instead of
recomputing upstream shuffles.

A staged folder stays until :func:`drop_staged` is called with its frame (the
result still to be computed may read it) or the application ends: every folder
is remembered and removed by :func:`drop_all_staged`, which is also registered
to run at interpreter exit.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from souk.session import checkpoint_dir

_STAGED: set[str] = set()


def staged_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder, remembered for cleanup."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/souk_stage/{label}-{uuid.uuid4().hex}"
    _STAGED.add(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _STAGED.discard(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the folders that these staged frames (returned by :func:`stage`)
    read. Call it once nothing will read them any more."""
    for df in frames:
        files = df.inputFiles()
        for path in [p for p in _STAGED if any(p.split(":", 1)[-1].lstrip("/") in f for f in files)]:
            _delete(df.sparkSession, path)


def drop_all_staged() -> None:
    """Delete every folder staged by this application and not dropped yet."""
    spark = SparkSession.getActiveSession()
    for path in list(_STAGED):
        with contextlib.suppress(Exception):     # at exit the JVM may be gone already
            if spark is not None:
                _delete(spark, path)


atexit.register(drop_all_staged)
