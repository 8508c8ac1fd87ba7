"""Writing results and registering the semantic layer.

The reference drops and recreates its tables, keeps the order-level
definition as a view and hands "tall" results to BI tools. Here: Parquet
writes with overwrite, optional partition columns, and temp views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a result (e.g. the tall cohort table) as Parquet; :func:`souk.operators.cohorts.cohort_matrix`
    is its wide form."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_tables(tables: dict[str, DataFrame], base: str, mode: str = "overwrite") -> None:
    """Persist loaded tables (e.g. after a CSV import) as Parquet, one folder
    per table, readable again with ``load_tables(spark, base, "parquet")``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{base.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """Expose tables and the order-level view to SQL users under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Rewrite only the partitions that ``df`` has rows for (a rerun of one month leaves
    the other months as they are); the first write makes the folder."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def read_partitions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`overwrite_partitions` wrote, with declared types (partition values are not guessed)."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
