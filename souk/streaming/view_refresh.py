"""The order-level view (O3) kept up to date from changes alone.

The stored state has one row per order: the order's columns, the sum of its payments, its
best review (with the key that makes it the best) and the customer's place. That is enough to
apply a change without the loaded tables: an order row replaces the one before, payments
are added (withdrawn ones subtracted), reviews compete by the load's rule, and places are
looked up again. Only the customers are read whole, as the dimension they are.

Rows are kept in parts by month of purchase, as changes mostly concern recent orders: a refresh rewrites
the months that hold a changed order (or an order of a changed customer) and leaves all others.
Rows without a purchase time, and payments or reviews whose order has not come yet, are in
part ``none`` until it does; that part is rewritten every time.

Refresh ``b`` writes ``batch=b/part=<month>`` from the newest earlier versions, so one that runs again
after a lost driver writes the same rows again; readers take each part's newest version
among finished refreshes (folder names only, no data is read to find it). Every
rewritten part has one row without an order id, so that a part whose orders all moved to
another month still has a version.

Cases: an order twice in one change counts with its greatest row (columns in their order);
null order ids are ignored; an order without a known customer is kept but not shown; extra
columns are ignored; an empty change rewrites part ``none`` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions.numeric import whole_days
from souk.operators.semantic import COLUMNS, delivery_experience
from souk.sources.schemas import TABLES
from souk.sources.staging import drop_staged, stage
from souk.streaming.upsert import committed_batches

NONE = "none"
ORDER = ["customer_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
         "order_estimated_delivery_date"]
PLACE = ["customer_unique_id", "customer_state", "customer_city"]
PAID = "decimal(22,2)"
BEST = "struct<answered: timestamp_ntz, review_id: string, score: int>"
STATE = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("has_order", T.BooleanType()),
    *[TABLES["orders"][c] for c in ORDER],
    T.StructField("paid", T.DecimalType(22, 2)),
    T.StructField("review", T.StructType([T.StructField("answered", T.TimestampNTZType()),
                                          T.StructField("review_id", T.StringType()), T.StructField("score", T.IntegerType())])),
    T.StructField("has_customer", T.BooleanType()),
    *[TABLES["customers"][c] for c in PLACE],
    T.StructField("part", T.StringType()),
])


def _part(purchase: str = "order_purchase_timestamp") -> F.Column:
    return F.coalesce(F.date_format(purchase, "yyyy-MM"), F.lit(NONE))


def newest_parts(spark: SparkSession, target: str, before: int | None = None) -> dict[str, str]:
    """Part -> folder of its newest version (of refreshes earlier than ``before``)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, str] = {}
    for batch in committed_batches(spark, target):
        if before is not None and batch >= before:
            break
        folder = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/batch={batch}")
        for status in folder.getFileSystem(conf).listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("part="):
                found[name[5:]] = f"{target.rstrip('/')}/batch={batch}/{name}"
    return found


def _read(spark: SparkSession, target: str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], STATE)
    return (spark.read.schema(STATE).option("basePath", target).parquet(*paths)
            .select(*STATE.fieldNames()).filter("order_id is not null"))


def read_view(spark: SparkSession, target: str) -> DataFrame:
    """The view as of the last finished refresh: the columns of ``order_level_metrics``."""
    state = _read(spark, target, list(newest_parts(spark, target).values()))
    return state.filter("has_order and has_customer").select(
        "*", whole_days("order_purchase_timestamp", "order_delivered_customer_date").alias("actual_delivery_days"),
        delivery_experience().alias("delivery_experience"), F.coalesce("paid", F.lit(0).cast(PAID)).alias("payment_value"),
        F.col("review.score").alias("review_score")).select(*COLUMNS)


def _lines(df: DataFrame, **columns: F.Column) -> DataFrame:
    """(order_id, line, paid, review): what one kind of row says about its order."""
    types = {"line": T.StructType([T.StructField("turn", T.IntegerType()), *[TABLES["orders"][c] for c in ORDER]]).simpleString(),
             "paid": PAID, "review": BEST}
    return df.select("order_id", *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _changed(change: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    best = F.struct(F.col("review_answer_timestamp").alias("answered"), "review_id", F.col("review_score").alias("score"))
    kinds = {"orders": lambda d: _lines(d, line=F.struct(F.lit(1).alias("turn"), *ORDER)),
             "order_payments": lambda d: _lines(d, paid=F.col("payment_value")),
             "order_payments_withdrawn": lambda d: _lines(d, paid=-F.col("payment_value")),
             "order_reviews": lambda d: _lines(d, review=best)}
    unknown = set(change) - set(kinds) - {"customers"}
    if unknown:
        raise ValueError(f"a change cannot hold {sorted(unknown)}")
    out = _lines(spark.createDataFrame([], "order_id string"))
    for kind, lines in kinds.items():
        if kind in change:
            out = out.unionByName(lines(change[kind]))
    return out.filter("order_id is not null")


def refresh_view(change: dict[str, DataFrame], customers: DataFrame, target: str, batch_id: int) -> list[str]:
    """Apply a change (any of ``orders``, ``order_payments``, ``order_payments_withdrawn``, ``order_reviews``:
    new rows; ``customers``: rows that differ) with ``customers`` as they are now. Returns the
    parts that were rewritten. Refreshes come in the order of their numbers; each may run
    any number of times."""
    spark = customers.sparkSession
    changed = stage(_changed(change, spark), "view-change")
    newest = newest_parts(spark, target, before=batch_id)
    # Months of changed orders, before and after: as many as there are months at most.
    index = _read(spark, target, list(newest.values())).select("order_id", "customer_id", "part")
    hit = [index.join(changed.select("order_id"), "order_id", "left_semi").select("part"),
           changed.filter("line is not null").select(_part("line.order_purchase_timestamp").alias("part"))]
    if "customers" in change:
        hit.append(index.join(change["customers"].select("customer_id"), "customer_id", "left_semi").select("part"))
    parts = hit[0]
    for more in hit[1:]:
        parts = parts.unionAll(more)
    touched = sorted({r["part"] for r in parts.distinct().collect()} | {NONE})

    old = _read(spark, target, [newest[p] for p in touched if p in newest])
    kept = _lines(old, line=F.when(F.col("has_order"), F.struct(F.lit(0).alias("turn"), *ORDER)), paid=F.col("paid"),
                  review=F.col("review"))
    merged = (kept.unionByName(changed).groupBy("order_id")
              .agg(F.max("line").alias("line"), F.sum("paid").cast(PAID).alias("paid"), F.max("review").alias("review"))
              .select("order_id", F.col("line").isNotNull().alias("has_order"), *[F.col(f"line.{c}").alias(c) for c in ORDER],
                      "paid", "review"))
    place = customers.select("customer_id", F.lit(True).alias("has_customer"), *PLACE)
    rows = merged.join(place, "customer_id", "left").select(
        *[F.coalesce("has_customer", F.lit(False)).alias(c) if c == "has_customer" else _part().alias(c) if c == "part"
          else F.col(c) for c in STATE.fieldNames()])
    marks = (spark.createDataFrame([(p,) for p in touched], "part string")
             .select(*[F.col(f.name) if f.name == "part" else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE]))
    # A month may hold most of the rows: partitions are split by size.
    (rows.unionByName(marks).hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part")
     .parquet(f"{target.rstrip('/')}/batch={batch_id}"))
    drop_staged(changed)
    return touched
