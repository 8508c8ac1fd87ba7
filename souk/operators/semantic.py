"""O3: the order-level semantic layer.

One row per order that has a customer, any status: customer person and
place, delivery days and experience, the order's total payment and its
review score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.numeric import whole_days

LATE = "Late"
ON_TIME = "On Time / Early"
UNKNOWN = "Unknown"
DELIVERED = "delivered"

COLUMNS = [
    "order_id", "customer_id", "customer_unique_id", "customer_state", "customer_city",
    "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
    "order_estimated_delivery_date", "actual_delivery_days", "delivery_experience",
    "payment_value", "review_score",
]


def delivery_experience(delivered: str = "order_delivered_customer_date",
                        estimated: str = "order_estimated_delivery_date") -> F.Column:
    """Late iff delivered after the estimate; equal is on time; a missing
    date on either side is unknown."""
    d, e = F.col(delivered), F.col(estimated)
    return (F.when(d > e, F.lit(LATE))
            .when(d <= e, F.lit(ON_TIME))
            .otherwise(F.lit(UNKNOWN)))


def order_payment_totals(payments: DataFrame) -> DataFrame:
    """Payments summed per order *before* any join, so instalments never
    multiply order rows."""
    return payments.groupBy("order_id").agg(F.sum("payment_value").alias("total_payment"))


def order_level_metrics(orders: DataFrame, customers: DataFrame, payments: DataFrame,
                        reviews: DataFrame | None = None) -> DataFrame:
    """Build the view. ``reviews=None`` skips the review join (and yields a
    NULL score) for callers that never read it; Spark cannot prove the join
    is one-to-one and would otherwise keep it.

    Join order: orders, per-order payment totals and reviews meet first on
    ``order_id`` (one partitioning; no exchange at all when the tables are
    bucketed by order), then the order rows meet customers on
    ``customer_id`` -- one shuffle of order-grain rows.
    """
    o = orders.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        "order_delivered_customer_date", "order_estimated_delivery_date")
    c = customers.select("customer_id", "customer_unique_id", "customer_state", "customer_city")
    df = o.join(order_payment_totals(payments), "order_id", "left")
    if reviews is not None:
        df = df.join(reviews.select("order_id", "review_score"), "order_id", "left")
        score = F.col("review_score")
    else:
        score = F.lit(None).cast("int")
    df = df.join(c, "customer_id", "inner")
    return df.select(
        "order_id", "customer_id", "customer_unique_id", "customer_state", "customer_city",
        "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
        "order_estimated_delivery_date",
        whole_days("order_purchase_timestamp", "order_delivered_customer_date")
        .alias("actual_delivery_days"),
        delivery_experience().alias("delivery_experience"),
        F.coalesce(F.col("total_payment"), F.lit(0).cast("decimal(22,2)")).alias("payment_value"),
        score.alias("review_score"),
    )


def delivered(olm: DataFrame) -> DataFrame:
    return olm.filter(F.col("order_status") == DELIVERED)
