"""Distinct customers per month, quarter, state and in all, mergeable over loads (the
distinct counts of the scorecard, the cohorts and the state report in one form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.bitmaps import build_bitmaps, distinct_counts, merge_bitmaps, roll_up
from souk.functions.numeric import month_start_text
from souk.operators.semantic import delivered

PERSON = "customer_unique_id"
GROUPS = ["facet", "value"]


def reach_bitmaps(olm: DataFrame, numbers: DataFrame) -> DataFrame:
    """(facet, value, bucket, bits) of one load's delivered orders: the persons of every month
    and every state. A person's places and months are a set, combined before the
    shuffle, so one with very many orders is one small row per task."""
    places = (delivered(olm).filter(F.col(PERSON).isNotNull()).groupBy(PERSON)
              .agg(F.collect_set(F.struct(month_start_text("order_purchase_timestamp").alias("month"), "customer_state")).alias("seen")))
    numbered = places.join(numbers, PERSON)
    facets = F.flatten(F.transform("seen", lambda s: F.array(
        F.struct(F.lit("month").alias("facet"), s["month"].alias("value")),
        F.struct(F.lit("state").alias("facet"), s["customer_state"].alias("value")))))
    rows = numbered.select("number", F.explode(F.array_distinct(facets)).alias("f"))
    return build_bitmaps(rows.select("f.facet", "f.value", "number"), GROUPS)


def customer_reach(*loads: DataFrame) -> DataFrame:
    """facet, value, customers: distinct customers of all loads together. Quarters and the
    network come from the months' bitmaps; no order is read again for them."""
    fine = merge_bitmaps(*loads, groups=GROUPS)
    months = fine.filter("facet = 'month'")
    quarters = roll_up(months, facet=F.lit("quarter"), value=F.date_format(
        F.date_trunc("quarter", F.to_date("value")), "yyyy-MM-dd"))
    network = roll_up(months, facet=F.lit("network"), value=F.lit("all"))
    return distinct_counts(fine.unionByName(quarters).unionByName(network), GROUPS, "customers").orderBy("facet", "value")
