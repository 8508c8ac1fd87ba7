"""Customer states with demand versus delivery service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.numeric import as_double, round2, safe_div
from souk.operators.semantic import LATE, delivered

PRIORITY = "Priority service recovery market"
CORE = "Core market to defend"
WATCH = "Operational watchlist"
STABLE = "Stable"


def _late_flag() -> F.Column:
    # 'Unknown' counts as not late.
    return F.when(F.col("delivery_experience") == LATE, 1).otherwise(0)


def state_service_gap(olm: DataFrame, min_orders: int = 500) -> DataFrame:
    """State metrics against two benchmarks: the network over *all*
    delivered orders, and the mean revenue of the states with at least
    ``min_orders`` delivered orders. All comparisons use the rounded values.

    One keyed aggregate per state (partial aggregation before the exchange)
    keeps the raw sums; the network benchmark is the sum of those sums over
    every state, taken before the ``min_orders`` filter, and the revenue
    benchmark an average over the qualifying states. Both are whole-frame
    window aggregates over the state table, which holds one row per state.
    """
    d = delivered(olm)
    # (state, person) first: distinct customers become a plain count, without an Expand.
    sums = ("pay_sum", "pay_n", "days_sum", "days_n", "late_sum", "rows", "score_sum", "score_n")
    person = d.groupBy("customer_state", "customer_unique_id").agg(
        F.sum("payment_value").alias("pay_sum"),
        F.count("payment_value").alias("pay_n"),
        F.sum("actual_delivery_days").alias("days_sum"),
        F.count("actual_delivery_days").alias("days_n"),
        F.sum(_late_flag()).alias("late_sum"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_n"))
    per_state = person.groupBy("customer_state").agg(
        F.sum("rows").cast("bigint").alias("delivered_orders"),
        F.count("customer_unique_id").cast("bigint").alias("active_customers"),
        *[F.sum(c).alias(c) for c in sums])
    every = Window.partitionBy()                      # one row per state: a small table
    network = per_state.select(
        "*",
        round2(safe_div(F.sum("days_sum").over(every), F.sum("days_n").over(every))).alias("net_days"),
        round2(F.lit(100.0) * safe_div(F.sum("late_sum").over(every), F.sum("rows").over(every)))
        .alias("net_late"),
        round2(safe_div(F.sum("score_sum").over(every), F.sum("score_n").over(every))).alias("net_review"))
    states = network.filter(F.col("delivered_orders") >= min_orders).select(
        "customer_state", "delivered_orders", "active_customers",
        round2("pay_sum").alias("revenue"),
        round2(safe_div("pay_sum", "pay_n")).alias("aov"),
        round2(safe_div("days_sum", "days_n")).alias("avg_delivery_days"),
        round2(F.lit(100.0) * safe_div("late_sum", "rows")).alias("late_rate_pct"),
        round2(safe_div("score_sum", "score_n")).alias("avg_review_score"),
        "net_days", "net_late", "net_review")
    states = states.withColumn("bench_revenue", round2(F.avg("revenue").over(every)))

    big = F.col("revenue") >= F.col("bench_revenue")
    late = F.col("late_rate_pct") > F.col("net_late")
    action = (F.when(big & late, F.lit(PRIORITY))
              .when(big, F.lit(CORE))
              .when(late & (F.col("avg_review_score") < F.col("net_review")), F.lit(WATCH))
              .otherwise(F.lit(STABLE)))
    return states.select(
        "customer_state", "delivered_orders", "active_customers", "revenue", "aov",
        "avg_delivery_days", "late_rate_pct", "avg_review_score",
        round2(as_double("avg_delivery_days") - F.col("net_days")).alias("delivery_days_vs_avg"),
        round2(F.col("late_rate_pct") - F.col("net_late")).alias("late_rate_vs_avg"),
        action.alias("market_action"),
    ).orderBy(F.col("revenue").desc(), F.col("late_rate_pct").desc())
