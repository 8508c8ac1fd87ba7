"""O10 category unit economics; O12d count of freight-heavy categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.numeric import as_double, pct, round2, safe_div, zscore
from souk.operators.sellers import review_totals
from souk.operators.semantic import DELIVERED

MARGIN = "Margin destructive"
CX = "CX recovery needed"
CORE = "Core growth category"
MONITOR = "Monitor"


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Product -> category name: the English translation, else the original
    name, else NULL (a NULL name is a group of its own)."""
    t = translation.select("product_category_name", "product_category_name_english")
    return (products.select("product_id", "product_category_name")
            .join(t, "product_category_name", "left")
            .select("product_id", F.coalesce("product_category_name_english", "product_category_name")
                    .alias("category_name")))


def category_base(items: DataFrame, orders: DataFrame, products: DataFrame, translation: DataFrame,
                  reviews: DataFrame | None) -> DataFrame:
    """Delivered items per category, as raw sums (nothing rounded yet).

    Items meet delivered orders and reviews first, on ``order_id`` (no shuffle of
    bucketed tables), and are summed per (order, product); only those rows meet
    products, and collapsing to (order, category) turns distinct orders into a
    plain count.
    """
    it = items.select("order_id", "product_id", "price", "freight_value")
    o = (orders.filter(F.col("order_status") == DELIVERED)
         .select("order_id", F.coalesce(F.col("order_delivered_customer_date")
                                        > F.col("order_estimated_delivery_date"), F.lit(False))
                 .alias("is_late")))
    x = it.join(o, "order_id", "inner")
    if reviews is not None:
        x = x.join(review_totals(reviews), "order_id", "left")
    else:
        x = x.withColumns({"score_sum": F.lit(None).cast("bigint"), "score_n": F.lit(None).cast("bigint")})
    order = ["order_id", "is_late", "score_sum", "score_n"]
    sums = ["n_items", "price", "n_priced", "freight", "gmv"]
    p = x.groupBy(*order, "product_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("price").alias("price"), F.count("price").alias("n_priced"),
        F.sum("freight_value").alias("freight"),
        F.sum(F.col("price") + F.col("freight_value")).alias("gmv"))
    p = p.join(product_categories(products, translation), "product_id", "inner")
    g = p.groupBy(*order, "category_name").agg(*[F.sum(c).alias(c) for c in sums])
    n = F.col("n_items")
    return g.groupBy("category_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("delivered_orders"),
        F.sum("price").alias("price_sum"),
        F.sum("n_priced").alias("n_priced"),
        F.sum("freight").alias("freight_sum"),
        F.sum("gmv").alias("gmv_sum"),
        F.sum(F.when(F.col("is_late"), n).otherwise(0)).alias("late_items"),
        F.sum(n).alias("items"),
        F.sum(n * F.col("score_sum")).alias("score_sum"),
        F.sum(n * F.col("score_n")).alias("scored_items"))


def category_economics(items: DataFrame, orders: DataFrame, products: DataFrame,
                       translation: DataFrame, reviews: DataFrame, min_orders: int = 100,
                       margin_ratio: float = 40.0, margin_price: float = 80.0,
                       late_pct: float = 15.0, low_review: float = 4.0,
                       core_share: float = 5.0, flags: bool = False, outlier_z: float = 2.0) -> DataFrame:
    """Categories with at least ``min_orders`` delivered orders: GMV,
    share, average price, freight ratio and its z-score, late rate, review,
    and an action label (first match wins). Shares and the freight
    benchmark are relative to the qualifying categories. ``flags`` adds
    ``freight_outlier`` (z above ``outlier_z``), the reference's prose rule."""
    b = category_base(items, orders, products, translation, reviews)
    cm = b.filter(F.col("delivered_orders") >= min_orders).select(
        "category_name", "delivered_orders",
        F.round(F.col("gmv_sum"), 2).alias("gmv_dec"),
        round2(safe_div("price_sum", "n_priced")).alias("avg_item_price"),
        round2(pct("freight_sum", "price_sum")).alias("freight_to_revenue_pct"),
        round2(pct("late_items", "items")).alias("late_delivery_rate_pct"),
        round2(safe_div("score_sum", "scored_items")).alias("avg_review_score"))
    # Benchmarks over the qualifying categories: whole-frame windows over a
    # table with one row per category (bounded by the category vocabulary).
    every = Window.partitionBy()
    x = cm.select("*", F.avg("freight_to_revenue_pct").over(every).alias("__mu"),
                  F.stddev_pop("freight_to_revenue_pct").over(every).alias("__sd"),
                  F.sum("gmv_dec").over(every).alias("__total_gmv"))
    share = pct("gmv_dec", "__total_gmv")
    action = (F.when((F.col("freight_to_revenue_pct") >= margin_ratio) & (F.col("avg_item_price") < margin_price),
                     F.lit(MARGIN))
              .when((F.col("late_delivery_rate_pct") >= late_pct) & (F.col("avg_review_score") < low_review),
                    F.lit(CX))
              .when(share >= core_share, F.lit(CORE))
              .otherwise(F.lit(MONITOR)))
    z = zscore("freight_to_revenue_pct", "__mu", "__sd")
    extra = [F.coalesce(z > outlier_z, F.lit(False)).alias("freight_outlier")] if flags else []
    return x.select(
        "category_name", "delivered_orders",
        as_double("gmv_dec").alias("gross_merchandise_value"),
        round2(share).alias("gmv_share_pct"),
        "avg_item_price", "freight_to_revenue_pct",
        z.alias("freight_pressure_z_score"),
        "late_delivery_rate_pct", "avg_review_score",
        action.alias("category_action"), *extra,
    ).orderBy(F.col("freight_pressure_z_score").desc(), F.col("gross_merchandise_value").desc())


def category_alerts(items: DataFrame, orders: DataFrame, products: DataFrame, translation: DataFrame,
                    min_orders: int = 100, ratio: float = 40.0) -> DataFrame:
    """O12d (one row): categories with at least ``min_orders`` delivered
    orders whose *unrounded* freight-to-price ratio reaches ``ratio`` percent."""
    b = category_base(items, orders, products, translation, None)
    hit = (F.col("delivered_orders") >= min_orders) & (pct("freight_sum", "price_sum") >= ratio)
    return b.agg(F.count(F.when(hit, 1)).cast("bigint").alias("margin_destructive_categories"))
