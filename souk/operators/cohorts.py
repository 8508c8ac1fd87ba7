"""Cohort retention in tall form (one row per cohort and month number)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.numeric import month_start_text, pct, round2, whole_months
from souk.functions.skew import salted_join
from souk.operators.semantic import delivered
from souk.sources.staging import stage

CUSTOMER = "customer_unique_id"


def first_purchases(olm: DataFrame) -> DataFrame:
    """First delivered purchase per person and its calendar month.

    A keyed aggregate, combined map-side, so a person with a huge number of
    orders costs one partial row per task instead of a whole window
    partition.
    """
    return (delivered(olm).groupBy(CUSTOMER)
            .agg(F.min("order_purchase_timestamp").alias("first_purchase_date"),
                 F.count(F.lit(1)).alias("n_orders"))
            .withColumn("cohort_month", month_start_text("first_purchase_date")))


def cohort_retention(olm: DataFrame, max_month: int = 12, **skew) -> DataFrame:
    """Cohort = month of the first delivered purchase; month number = whole
    months elapsed since that first timestamp (so a purchase in the next
    calendar month can still be month 0). Months 0..``max_month``; months
    without activity are absent, not zero.

    Plan: first purchases are aggregated per person, joined back to the
    delivered orders on the person (a person with very many orders is
    salted over several tasks, :func:`souk.functions.skew.salted_join`),
    aggregated per (cohort, month number); cohort sizes are a tiny aggregate
    joined at the end.
    """
    # Read three times (cohort sizes, hot-key list, join): one row per person,
    # materialised once.
    firsts = stage(first_purchases(olm), "first-purchases")
    orders = delivered(olm).select(CUSTOMER, "order_id", "order_purchase_timestamp", "payment_value")
    activity = (salted_join(orders, firsts, CUSTOMER, count_col="n_orders", salt_by="order_id", **skew)
                .select(CUSTOMER, "cohort_month",
                        whole_months("first_purchase_date", "order_purchase_timestamp").alias("month_number"),
                        "payment_value")
                .filter(F.col("month_number") <= max_month))
    cells = activity.groupBy("cohort_month", "month_number").agg(
        F.countDistinct(CUSTOMER).alias("retained_customers"),
        F.sum("payment_value").alias("retained_revenue"))
    sizes = firsts.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    return (cells.join(sizes, "cohort_month", "inner")
            .select("cohort_month",
                    F.col("cohort_size").cast("bigint").alias("cohort_size"),
                    F.col("month_number").cast("bigint").alias("month_number"),
                    F.col("retained_customers").cast("bigint").alias("retained_customers"),
                    round2(pct("retained_customers", "cohort_size")).alias("retention_pct"),
                    round2("retained_revenue").alias("retained_revenue"))
            .orderBy("cohort_month", "month_number"))


def cohort_matrix(tall: DataFrame, months: int = 12, value: str = "retention_pct") -> DataFrame:
    """The tall table as a matrix for BI tools: a row per cohort, columns ``m0`` to
    ``m{months}`` (NULL where a cohort has no row). The months are declared, so the pivot is
    one aggregate without a scan for its columns; several writes give the same columns."""
    wide = tall.groupBy("cohort_month").pivot("month_number", list(range(months + 1))).agg(F.max(value))
    return wide.select("cohort_month", *[F.col(f"`{m}`").alias(f"m{m}") for m in range(months + 1)])
