"""Spark session defaults for the library.

Nothing here overrides what a cluster already set: every option is applied
only when the session has no value for it, so a deployment keeps control of
shuffle sizing, checkpoint location and memory.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Options the library relies on for correct results (time zone: timestampdiff
# interprets NTZ values in the session zone) and for skew handling at scale.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "souk") -> SparkSession:
    """Local session for tests and the benchmark.

    On a cluster use the existing session and call :func:`configure` on it.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Local runs: small shuffles would otherwise be coalesced into one
        # task; keep the cores busy. Clusters keep their own setting.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`REQUIRED_CONF` where unset and make sure a checkpoint
    directory exists (the cluster's ``spark.checkpoint.dir`` wins)."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    # The time zone is a correctness setting, not a tuning knob.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A private scratch folder is created only when the setting is absent *and*
    the master runs in this one process (tests, benchmark). On a cluster a
    machine-local folder would be invisible to the other executors, so the
    missing setting is an error there.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not is_single_process(sc.master):
        raise ValueError(
            f"spark.checkpoint.dir is not set (master {sc.master}); set it to a folder "
            "that the driver and every executor share")
    local = tempfile.mkdtemp(prefix="souk-ckpt-", dir=os.environ.get("SOUK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def is_single_process(master: str) -> bool:
    """``local``, ``local[n]``, ``local[n,m]`` -- not ``local-cluster[...]``."""
    return master == "local" or master.startswith("local[")
