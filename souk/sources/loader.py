"""Loading the nine tables (CSV export or Parquet) with declared schemas.

The reference imports CSV files into keyed tables; Spark enforces no keys,
so the one key results depend on (one review per order) is restored here and
every key is reported afterwards by :func:`souk.operators.quality.check_constraints`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.csv_records import import_csv
from souk.sources.schemas import TABLES

#: Options of the engine's own reader (streams read whole files with it).
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",          # review texts contain newlines
    "quote": '"',
    "escape": '"',                # doubled quotes inside quoted fields
    "mode": "FAILFAST",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
}


def _path(base: str, table: str, fmt: str, paths: dict[str, str] | None) -> str:
    if paths and table in paths:
        return paths[table]
    return f"{base.rstrip('/')}/{table}.{fmt}"


def read_table(spark: SparkSession, table: str, base: str, fmt: str = "parquet",
               paths: dict[str, str] | None = None, rejects: dict[str, DataFrame] | None = None) -> DataFrame:
    """One table. CSV is imported in parallel (:mod:`souk.sources.csv_records`); records that
    do not fit the schema end the load with an error, or go to ``rejects`` by table name
    where that is given."""
    path = _path(base, table, fmt, paths)
    if fmt == "csv":
        got = import_csv(spark, TABLES[table], path)
        if rejects is not None:
            rejects[table] = got.rejects
        elif bad := got.rejects.limit(3).collect():          # a few examples for the message
            raise ValueError(f"{table}: records that do not fit the schema, such as {[r.record for r in bad]}")
        return got.rows
    if fmt == "parquet":
        return spark.read.schema(TABLES[table]).parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def dedupe_reviews(reviews: DataFrame) -> DataFrame:
    """Keep one review per order: the latest answer, then the greatest review id.

    Done as a keyed aggregate of a struct (map-side combined, so an order
    with very many reviews does not land whole in one task) instead of a
    window over the order.
    """
    cols = [c for c in reviews.columns if c not in ("order_id",)]
    ordered = ["review_answer_timestamp", "review_id"] + [
        c for c in cols if c not in ("review_answer_timestamp", "review_id")]
    best = F.max(F.struct(*[F.col(c) for c in ordered])).alias("r")
    return (reviews.groupBy("order_id").agg(best)
            .select(*[F.col(f"r.{c}").alias(c) if c != "order_id" else F.col("order_id")
                      for c in reviews.columns]))


def normalise(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Trim and case-fold the few text columns whose values are compared or grouped:
    statuses, states and category names. Ids are opaque and left alone. Full equality of
    the reference's collation (accents too) is :func:`souk.functions.collation.collate_tables`."""
    out = dict(tables)
    out["orders"] = out["orders"].withColumn("order_status", F.lower(F.trim("order_status")))
    out["customers"] = out["customers"].withColumn("customer_state", F.upper(F.trim("customer_state")))
    out["sellers"] = out["sellers"].withColumn("seller_state", F.upper(F.trim("seller_state")))
    out["products"] = out["products"].withColumn(
        "product_category_name", F.lower(F.trim("product_category_name")))
    out["product_category_name_translation"] = out["product_category_name_translation"].withColumn(
        "product_category_name", F.lower(F.trim("product_category_name")))
    return out


def import_report(raw: dict[str, DataFrame], loaded: dict[str, DataFrame],
                  rejects: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per table: rows read, rows kept and rows dropped by the load (repeated
    reviews of an order; no other table loses rows); with ``rejects`` also the records that
    do not fit the schema."""
    parts = []
    for name in sorted(raw):
        read, kept = (t[name].agg(F.count(F.lit(1)).alias(c)) for t, c in ((raw, "rows_read"), (loaded, "rows_kept")))
        # One-row frames: a scalar each, no join.
        cols = [F.lit(name).alias("table_name"), F.col("rows_read"), kept.scalar().alias("rows_kept")]
        if rejects is not None:
            cols.append(rejects[name].agg(F.count(F.lit(1))).scalar().alias("rows_rejected"))
        parts.append(read.select(*cols))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report.withColumn("rows_dropped", F.col("rows_read") - F.col("rows_kept"))


def load_tables(spark: SparkSession, base: str, fmt: str = "parquet", *,
                paths: dict[str, str] | None = None, unique_reviews: bool = True,
                normalise_text: bool = False, rejects: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """O1: the nine tables as DataFrames keyed by table name (Parquet is read lazily, CSV is
    imported once). ``rejects`` receives the CSV records that do not fit, per table."""
    tables = {name: read_table(spark, name, base, fmt, paths, rejects) for name in TABLES}
    if unique_reviews:
        tables["order_reviews"] = dedupe_reviews(tables["order_reviews"])
    if normalise_text:
        tables = normalise(tables)
    return tables
