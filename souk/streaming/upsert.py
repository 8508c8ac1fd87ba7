"""Incremental import of reviews under their key: one review per order, whatever the order
in which files arrive and however often a batch is run again.

The table is a folder of runs. Batch ``b`` writes one run, ``batch=b/since=s``: the batch and the
earlier runs back to batch ``s``, reduced by the load's rule (latest answer, then greatest review
id). ``s`` follows from ``b`` alone (:func:`covers_since`): every second batch writes just itself,
every fourth the last four, and so on, so a review is rewritten about once each time the
number of batches doubles, whatever the size of the table. Readers take the newest run, the
newest before all that it covers, and so on: a logarithm of the number of batches, reduced
once more.

The rule is a maximum, so order and repetition of files do not matter, and a batch that runs
again after a lost driver writes the same run again from the same earlier ones. A folder
counts once its job is committed (``_SUCCESS``). A folder without ``since=`` covers its own batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from souk.sources.loader import CSV_OPTIONS, dedupe_reviews
from souk.sources.schemas import TABLES

PARTS = 64
SCHEMA = TABLES["order_reviews"]


def committed_batches(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the finished batches (folder names, no data is read)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(target)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def covers_since(batch_id: int) -> int:
    """First batch of the run that this one writes: back by the greatest power of two that
    divides its place (from 1)."""
    place = batch_id + 1
    return place - (place & -place)


def runs(spark: SparkSession, target: str, before: int | None = None, since: int = 0) -> list[str]:
    """Folders that together hold all finished batches from ``since`` up to ``before``, newest first
    (folder names, no data is read)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, upto = [], before
    for batch in reversed(committed_batches(spark, target)):
        if batch < since:
            break
        if upto is not None and batch >= upto:
            continue
        path, upto = f"{target.rstrip('/')}/batch={batch}", batch
        folder = jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in folder.getFileSystem(conf).listStatus(folder)]
        covered = [int(n[6:]) for n in names if n.startswith("since=")]
        if covered:
            path, upto = f"{path}/since={covered[0]}", covered[0]
        if covered or any(n.startswith("part=") for n in names):               # else a batch without rows
            found.append(path)
    return found


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Rows of the given runs; several may hold an order."""
    rows = spark.createDataFrame([], SCHEMA)
    for folder in folders:
        rows = rows.unionByName(spark.read.schema(SCHEMA).parquet(folder).select(*SCHEMA.fieldNames()))
    return rows


def read_reviews(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the last finished batch."""
    folders = runs(spark, target)
    rows = _read(spark, folders)
    return rows if len(folders) == 1 and "/since=" in folders[0] else dedupe_reviews(rows)


def merge_batch(batch: DataFrame, batch_id: int, target: str, parts: int = PARTS) -> None:
    """Write the run of batch ``batch_id`` in at most ``parts`` files. May run any number of times."""
    spark, since = batch.sparkSession, covers_since(batch_id)
    earlier = _read(spark, runs(spark, target, batch_id, since))
    rows = dedupe_reviews(earlier.unionByName(batch.select(*SCHEMA.fieldNames())))
    (rows.coalesce(parts).withColumn("since", F.lit(since)).write.mode("overwrite").partitionBy("since")
     .parquet(f"{target.rstrip('/')}/batch={batch_id}"))


def upsert_reviews(spark: SparkSession, source_dir: str, target: str, checkpoint: str, fmt: str = "csv",
                   available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Keep ``target`` up to date with the review files that arrive in ``source_dir``."""
    reader = spark.readStream.schema(SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.options(**CSV_OPTIONS).csv(source_dir) if fmt == "csv" else reader.parquet(source_dir)
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, n: merge_batch(df, n, target)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
