"""O9 seller concentration and operational risk; O12c seller Pareto share."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions import ranking
from souk.functions.numeric import as_double, pct, round2, safe_div, whole_days, zscore
from souk.functions.selection import Share, cut_rows
from souk.operators.semantic import DELIVERED
from souk.sources.staging import stage

SELLER = "seller_id"


def _order_seller_grain(items: DataFrame, orders: DataFrame, reviews: DataFrame | None) -> DataFrame:
    """Items collapsed to one row per (order, seller) with the item count and
    amount, joined to the order's status, delivery and review.

    Items, orders and reviews all meet on ``order_id``; the (order, seller)
    aggregate then reuses that partitioning, so distinct orders per seller
    become plain counts without an extra exchange or an Expand.
    """
    it = items.select("order_id", SELLER, (F.col("price") + F.col("freight_value")).alias("amount"))
    o = orders.select(
        "order_id",
        (F.col("order_status") == DELIVERED).alias("is_delivered"),
        whole_days("order_purchase_timestamp", "order_delivered_customer_date").alias("days"),
        F.coalesce(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"),
                   F.lit(False)).alias("is_late"))
    x = it.join(o, "order_id", "inner")
    if reviews is not None:
        x = x.join(review_totals(reviews), "order_id", "left")
    else:
        x = x.withColumns({"score_sum": F.lit(None).cast("bigint"), "score_n": F.lit(None).cast("bigint")})
    return x.groupBy("order_id", SELLER, "is_delivered", "days", "is_late", "score_sum", "score_n").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("amount").alias("amount"))


def review_totals(reviews: DataFrame) -> DataFrame:
    """Scores summed per order before any join: an order with several reviews
    stays one row, so item and order counts do not rely on the review key."""
    return reviews.groupBy("order_id").agg(F.sum("review_score").alias("score_sum"),
                                           F.count("review_score").alias("score_n"))


def seller_metrics(items: DataFrame, orders: DataFrame, sellers: DataFrame, reviews: DataFrame,
                   min_orders: int = 30) -> DataFrame:
    """Item-weighted seller metrics. GMV, delivery days and review use
    delivered items; the late rate divides by items of *any* status."""
    g = _order_seller_grain(items, orders, reviews)
    dlv = F.col("is_delivered")
    n = F.col("n_items")
    days_w = F.when(dlv & F.col("days").isNotNull(), n)
    score_w = F.when(dlv, n * F.col("score_n"))
    # Aggregate per seller first (combined map-side, so a seller with a third
    # of all items is not one task's work), then attach the state: the same
    # groups as joining first and grouping by (seller, state).
    per_seller = g.groupBy(SELLER).agg(
        F.count(F.when(dlv, 1)).cast("bigint").alias("delivered_orders"),
        F.round(F.sum(F.when(dlv, F.col("amount")).otherwise(F.lit(0))), 2).alias("gmv"),
        round2(safe_div(F.sum(days_w * F.col("days")), F.sum(days_w))).alias("avg_delivery_days"),
        round2(pct(F.sum(F.when(dlv & F.col("is_late"), n).otherwise(0)), F.sum(n)))
        .alias("late_delivery_rate_pct"),
        round2(safe_div(F.sum(F.when(dlv, n * F.col("score_sum"))), F.sum(score_w))).alias("avg_review_score"))
    return (per_seller.filter(F.col("delivered_orders") >= min_orders)
            .join(sellers.select(SELLER, "seller_state"), SELLER, "inner")
            .select(SELLER, "seller_state", "delivered_orders", "gmv", "avg_delivery_days",
                    "late_delivery_rate_pct", "avg_review_score"))


def seller_risk(items: DataFrame, orders: DataFrame, sellers: DataFrame, reviews: DataFrame,
                min_orders: int = 30, top: int = 50, cum_pct: float = 80.0,
                with_decile: bool = False, flags: bool = False, alert_z: float = 1.5,
                outlier_z: float = 2.0, partitions: int | None = None) -> DataFrame:
    """Sellers ranked by GMV (ties by seller id) with GMV share,
    cumulative share and z-scores of late rate and review against the
    qualifying sellers. Kept: rank <= ``top`` or cumulative share <= ``cum_pct``.

    Optional columns: ``with_decile`` adds ``gmv_decile`` (NTILE(10) by GMV);
    ``flags`` adds ``late_rate_alert`` (top GMV decile and late-rate z above
    ``alert_z``) and ``late_rate_outlier`` (z above ``outlier_z``), the alert
    rules the reference recommends in prose.
    """
    # Read by the benchmark subquery and the ranking: materialise once (one row
    # per qualifying seller).
    sm = stage(seller_metrics(items, orders, sellers, reviews, min_orders), "seller-metrics")
    stats = sm.agg(F.struct(F.avg("late_delivery_rate_pct").alias("mu_late"),
                            F.stddev_pop("late_delivery_rate_pct").alias("sd_late"),
                            F.avg("avg_review_score").alias("mu_review"),
                            F.stddev_pop("avg_review_score").alias("sd_review"))).scalar()
    ranked = ranking.global_rank(sm, [("gmv", False), (SELLER, True)], prefix="g", value="gmv", partitions=partitions)
    cum = round2(pct("g_running", "g_total"))
    cols = [
        F.col("g_rn").alias("seller_rank"), SELLER, "seller_state", "delivered_orders",
        as_double("gmv").alias("gmv"),
        round2(pct("gmv", "g_total")).alias("gmv_share_pct"),
        cum.alias("cumulative_gmv_share_pct"),
        "avg_delivery_days", "late_delivery_rate_pct",
        zscore("late_delivery_rate_pct", stats["mu_late"], stats["sd_late"]).alias("late_rate_z_score"),
        "avg_review_score",
        zscore("avg_review_score", stats["mu_review"], stats["sd_review"]).alias("review_score_z_score"),
    ]
    decile = ranking.ntile("g_rn", "g_n", 10)
    if with_decile:
        cols.append(decile.alias("gmv_decile"))
    if flags:
        z = zscore("late_delivery_rate_pct", stats["mu_late"], stats["sd_late"])
        cols.append(F.coalesce((decile == 1) & (z > alert_z), F.lit(False)).alias("late_rate_alert"))
        cols.append(F.coalesce(z > outlier_z, F.lit(False)).alias("late_rate_outlier"))
    return (ranked.filter((F.col("g_rn") <= top) | (cum <= cum_pct))
            .select(*cols).orderBy("seller_rank"))


def seller_revenue(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Delivered GMV per seller, no minimum."""
    o = orders.filter(F.col("order_status") == DELIVERED).select("order_id")
    return (items.select("order_id", SELLER, (F.col("price") + F.col("freight_value")).alias("amount"))
            .join(o, "order_id", "inner")
            .groupBy(SELLER).agg(F.sum("amount").alias("gmv")))


def seller_pareto(items: DataFrame, orders: DataFrame, target: float = 0.80) -> DataFrame:
    """O12c (one row): percent of sellers, by descending GMV, needed to reach
    ``target`` of delivered GMV: the place of the first seller at which the running GMV
    reaches the target (weighted selection, no sort), over the seller count."""
    sr = stage(seller_revenue(items, orders), "seller-revenue")
    ((cut,),) = cut_rows(sr, SELLER, [Share("gmv", Decimal(str(target)))])
    place = F.lit(None).cast("bigint") if cut is None else F.lit(cut.place).cast("bigint")
    return sr.agg(round2(pct(place, F.count(F.lit(1)))).alias("seller_pct_for_80pct_gmv"))
