"""souk: marketplace analytics on Spark DataFrames.

Load the nine marketplace tables (:func:`souk.sources.loader.load_tables`),
build the order-level view (:func:`souk.operators.semantic.order_level_metrics`)
and run the analyses in :mod:`souk.operators`.
"""

from souk.operators.actions import action_board, repeat_rate_gap, revenue_concentration
from souk.operators.categories import category_alerts, category_economics
from souk.operators.cohorts import cohort_retention
from souk.operators.kpi import monthly_kpi
from souk.operators.quality import check_constraints, missing_timestamp_count, payment_reconciliation
from souk.operators.rfm import rfm_segments
from souk.operators.sellers import seller_pareto, seller_risk
from souk.operators.semantic import order_level_metrics
from souk.operators.states import state_service_gap
from souk.sources.loader import load_tables

__all__ = [
    "action_board", "category_alerts", "category_economics", "check_constraints", "cohort_retention",
    "load_tables", "missing_timestamp_count", "monthly_kpi", "order_level_metrics",
    "payment_reconciliation", "repeat_rate_gap", "revenue_concentration", "rfm_segments",
    "seller_pareto", "seller_risk", "state_service_gap",
]
