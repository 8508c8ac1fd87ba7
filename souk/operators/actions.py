"""The executive action board and its four one-row analyses
(O12a repeat-rate gap, O12b revenue concentration; O12c and O12d live with
sellers and categories)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.numeric import decimal_text, pct, round2
from souk.functions.selection import Tiles, after, cut_rows
from souk.operators import categories, sellers
from souk.operators.semantic import LATE, ON_TIME, delivered
from souk.sources.staging import stage

CUSTOMER = "customer_unique_id"

# Fixed texts of the board (priorities, initiatives, evidence and advice).
REPEAT_INITIATIVE = "First-order delivery recovery"
REPEAT_EVIDENCE = ("90-day repeat-rate gap between on-time and late first orders: ", " pp")
REPEAT_ACT = ("Recalibrate ETA promises, prioritize first-order parcels, and trigger service "
              "recovery for late first purchases.")
REPEAT_KEEP = "Maintain SLA monitoring; first-order delay is not creating a severe repeat-rate penalty."
VIP_INITIATIVE = "High-value customer retention"
VIP_EVIDENCE = ("Top revenue quintile contributes ", "% of delivered revenue")
VIP_ACT = "Launch VIP retention, proactive support, and win-back programs for top-spend customers."
VIP_KEEP = "Revenue concentration is moderate; balance acquisition with lifecycle automation."
SELLER_INITIATIVE = "Seller concentration risk"
SELLER_EVIDENCE = ("% of sellers generate 80% of delivered GMV",)
SELLER_ACT = ("Treat top sellers as critical accounts with SLA scorecards, escalation paths, "
              "and assortment backup plans.")
SELLER_KEEP = ("Seller base is relatively diversified; continue recruiting and scaling reliable "
               "mid-tier sellers.")
CATEGORY_INITIATIVE = "Category margin cleanup"
CATEGORY_EVIDENCE = (" categories exceed a 40% freight-to-revenue ratio",)
CATEGORY_ACT = ("Bundle bulky low-ticket products, enforce minimum basket rules, or renegotiate "
                "shipping economics in flagged categories.")
CATEGORY_KEEP = "No major category breaches the freight pressure threshold; keep monitoring as mix evolves."


def repeat_flags(olm: DataFrame, days: int = 90) -> DataFrame:
    """Per person: 1 if the second delivered order (by purchase time, order id)
    falls at or before the first purchase plus ``days`` (time of day kept), else 0;
    a later order can only be later than the second. Two rows per person are enough:
    the engine cuts each task's rows to two per person before the shuffle, so a person
    with very many orders is not one task's work."""
    w = Window.partitionBy(CUSTOMER).orderBy(F.col("order_purchase_timestamp").asc_nulls_first(), "order_id")
    top = (delivered(olm).select(CUSTOMER, "order_id", "order_purchase_timestamp", "delivery_experience")
           .withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= 2))
    first, second = F.col("nth") == 1, F.col("nth") == 2
    per = top.groupBy(CUSTOMER).agg(
        F.max(F.when(first, F.col("order_purchase_timestamp"))).alias("first_ts"),
        F.max(F.when(first, F.col("delivery_experience"))).alias("first_experience"),
        F.max(F.when(second, F.col("order_purchase_timestamp"))).alias("second_ts"))
    back = F.col("second_ts") <= F.col("first_ts") + F.make_dt_interval(days=F.lit(days))
    return per.select(CUSTOMER, "first_experience", F.when(back, 1).otherwise(0).alias("repeated_within_90d"))


def repeat_rate_gap(olm: DataFrame, days: int = 90) -> DataFrame:
    """O12a (one row): 90-day repeat rate after an on-time first order minus
    after a late one, in points; unknown first orders are left out; 0 when
    either side is missing."""
    rates = (repeat_flags(olm, days).filter(F.col("first_experience").isin(ON_TIME, LATE))
             .groupBy("first_experience")
             .agg((F.lit(100.0) * F.avg("repeated_within_90d")).alias("rate")))
    on = F.max(F.when(F.col("first_experience") == ON_TIME, F.col("rate")))
    late = F.max(F.when(F.col("first_experience") == LATE, F.col("rate")))
    return rates.agg(F.coalesce(round2(on - late), F.lit(0.0)).alias("repeat_rate_gap_pp"))


def revenue_concentration(olm: DataFrame, tiles: int = 5) -> DataFrame:
    """O12b (one row): percent of delivered revenue from the top spend tile
    (NTILE over spend ascending, ties by person id): what lies behind the last
    person of the tile before it, found by exact selection."""
    rev = stage(delivered(olm).groupBy(CUSTOMER).agg(F.sum("payment_value").alias("monetary")), "spend")
    ((*_, cut),) = cut_rows(rev, CUSTOMER, [Tiles("monetary", tiles)]) if tiles > 1 else [[None]]
    top = F.lit(tiles == 1) if cut is None else after("monetary", CUSTOMER, True, cut)
    return rev.agg(round2(pct(F.sum(F.when(top, F.col("monetary")).otherwise(F.lit(0))), F.sum("monetary")))
                   .alias("top_customer_quintile_revenue_share_pct"))


def _row(priority: str, initiative: str, evidence: F.Column, recommendation: F.Column) -> list[F.Column]:
    return [F.lit(priority).alias("priority"), F.lit(initiative).alias("initiative"),
            evidence.alias("evidence"), recommendation.alias("recommendation")]


def action_board(olm: DataFrame, items: DataFrame, orders: DataFrame, products: DataFrame,
                 translation: DataFrame, *, days: int = 90, tiles: int = 5, target: float = 0.80,
                 ratio: float = 40.0, min_orders: int = 100, gap_pp: float = 5.0, share_pct: float = 50.0,
                 seller_pct: float = 20.0, categories_over: int = 0) -> DataFrame:
    """Four prioritised actions, each from a one-row analysis.
    Numbers are printed as two-place decimals, counts as integers. The parameters
    of the analyses and the thresholds of the advice are arguments."""
    gap = repeat_rate_gap(olm, days)
    share = revenue_concentration(olm, tiles)
    pareto = sellers.seller_pareto(items, orders, target)
    alerts = categories.category_alerts(items, orders, products, translation, min_orders, ratio)

    g, s = F.col("repeat_rate_gap_pp"), F.col("top_customer_quintile_revenue_share_pct")
    p, c = F.col("seller_pct_for_80pct_gmv"), F.col("margin_destructive_categories")
    rows = [
        gap.select(*_row("P1", REPEAT_INITIATIVE,
                         F.concat(F.lit(REPEAT_EVIDENCE[0]), decimal_text(g), F.lit(REPEAT_EVIDENCE[1])),
                         F.when(g >= gap_pp, F.lit(REPEAT_ACT)).otherwise(F.lit(REPEAT_KEEP)))),
        share.select(*_row("P1", VIP_INITIATIVE,
                           F.concat(F.lit(VIP_EVIDENCE[0]), decimal_text(s), F.lit(VIP_EVIDENCE[1])),
                           F.when(s >= share_pct, F.lit(VIP_ACT)).otherwise(F.lit(VIP_KEEP)))),
        pareto.select(*_row("P1", SELLER_INITIATIVE,
                            F.concat(decimal_text(p), F.lit(SELLER_EVIDENCE[0])),
                            F.when(p <= seller_pct, F.lit(SELLER_ACT)).otherwise(F.lit(SELLER_KEEP)))),
        alerts.select(*_row("P2", CATEGORY_INITIATIVE,
                            F.concat(c.cast("string"), F.lit(CATEGORY_EVIDENCE[0])),
                            F.when(c > categories_over, F.lit(CATEGORY_ACT)).otherwise(F.lit(CATEGORY_KEEP)))),
    ]
    board = rows[0]
    for r in rows[1:]:
        board = board.unionByName(r)
    return board.orderBy("priority", "initiative")
