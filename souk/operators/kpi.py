"""Month-over-month KPI scorecard of delivered orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.numeric import as_double, month_start_text, round2, safe_div
from souk.operators.semantic import delivered


def monthly_kpi(olm: DataFrame) -> DataFrame:
    """Orders, distinct customers, revenue, revenue per customer and growth
    against the previous month *present* in the data.

    The month aggregate is the only wide step; the LAG then runs over one row
    per calendar month (a few hundred rows at most), where a single ordered
    partition is the right plan.
    """
    # One row per order in, one per (month, person), then one per month: distinct
    # customers become a plain count, without an Expand.
    person = (delivered(olm)
              .groupBy(month_start_text("order_purchase_timestamp").alias("cohort_month"), "customer_unique_id")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("payment_value").alias("paid")))
    monthly = (person.groupBy("cohort_month")
               .agg(F.sum("n").alias("total_orders"),
                    F.count("customer_unique_id").alias("active_customers"),
                    F.sum("paid").alias("total_revenue")))
    prev = F.lag("total_revenue").over(Window.orderBy("cohort_month"))
    return monthly.select(
        "cohort_month",
        F.col("total_orders").cast("bigint").alias("total_orders"),
        F.col("active_customers").cast("bigint").alias("active_customers"),
        as_double("total_revenue").alias("total_revenue"),
        round2(safe_div("total_revenue", "active_customers")).alias("aov"),
        as_double(prev).alias("prev_month_revenue"),
        round2(F.lit(100.0) * as_double(F.col("total_revenue") - prev)
               / F.nullif(as_double(prev), F.lit(0.0))).alias("mom_growth_pct"),
    ).orderBy("cohort_month")
