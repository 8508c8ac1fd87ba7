"""Incremental import of CSV exports into the Parquet tables.

A file-source stream per table with the declared schema (never inferred),
appended to the table's Parquet folder. The checkpoint records which files were
taken, so a rerun with the same checkpoint (by another application too, after a
lost driver) imports each file exactly once. It must be a stable folder that
belongs to the target, so it has no default: a folder that is new in each application
would disagree with the target's own log.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from souk.sources.loader import CSV_OPTIONS
from souk.sources.schemas import TABLES


def ingest_csv(spark: SparkSession, table: str, source_dir: str, target_dir: str,
               checkpoint: str, available_now: bool = True,
               max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start importing CSV files that arrive in ``source_dir`` into
    ``target_dir`` as Parquet. ``available_now`` processes what is there and
    stops; otherwise the query keeps watching the folder."""
    reader = spark.readStream.schema(TABLES[table]).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.csv(source_dir)
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", target_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
