"""RFM customer segments (recency, frequency, monetary quintiles)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.numeric import calendar_days
from souk.functions.selection import Tiles, cut_rows, tile
from souk.operators.semantic import delivered
from souk.sources.staging import stage

CUSTOMER = "customer_unique_id"

CHAMPIONS = "1. Champions"
AT_RISK_WHALES = "2. At Risk Whales"
NEW_PROMISING = "3. New Promising"
GENERAL = "4. General"


def customer_rfm(olm: DataFrame, orders: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Per person over delivered orders (the view has one row per order): days from the reference date to the
    last purchase, distinct orders and total payments. The reference date is
    the latest purchase of *any* status unless ``as_of`` is given (a scalar
    subquery, computed once)."""
    per = (delivered(olm).groupBy(CUSTOMER)
           .agg(F.max("order_purchase_timestamp").alias("last_purchase"),
                F.count(F.lit(1)).cast("bigint").alias("frequency"),
                F.sum("payment_value").alias("monetary")))
    if as_of is None:
        ref = orders.agg(F.max("order_purchase_timestamp")).scalar()
    else:
        ref = F.lit(as_of).cast("timestamp_ntz")
    return per.select(CUSTOMER, calendar_days(ref, "last_purchase").cast("bigint").alias("recency"),
                      "frequency", "monetary")


def segment(r: str = "r_score", f: str = "f_score", m: str = "m_score") -> F.Column:
    r, f, m = F.col(r), F.col(f), F.col(m)
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), F.lit(CHAMPIONS))
            .when((r <= 2) & (f >= 4) & (m >= 4), F.lit(AT_RISK_WHALES))
            .when((r >= 4) & (f <= 2), F.lit(NEW_PROMISING))
            .otherwise(F.lit(GENERAL)))


def rfm_scores(olm: DataFrame, orders: DataFrame, as_of: dt.datetime | None = None,
               tiles: int = 5) -> DataFrame:
    """All customers with their three scores and segment. Higher is better
    on every score: recency is tiled descending. Every ordering ends with the
    person id so tiles are deterministic when values tie. The last customers of the
    tiles of all three scores are found together by exact selection
    (:func:`souk.functions.selection.cut_rows`); scores are comparisons with them."""
    x = stage(customer_rfm(olm, orders, as_of), "rfm")         # one row per person, read by every scan of the selection
    specs = [Tiles("recency", tiles, False), Tiles("frequency", tiles), Tiles("monetary", tiles)]
    cuts = cut_rows(x, CUSTOMER, specs)
    r, f, m = (tile(s.value, CUSTOMER, s.ascending, c) for s, c in zip(specs, cuts, strict=True))
    return x.select(CUSTOMER, "recency", "frequency", F.col("monetary").cast("double").alias("monetary"),
                    r.alias("r_score"), f.alias("f_score"), m.alias("m_score")).withColumn("segment", segment())


def rfm_segments(olm: DataFrame, orders: DataFrame, as_of: dt.datetime | None = None,
                 limit: int | None = 50) -> DataFrame:
    """The ``limit`` customers with the highest spend (top-k report),
    ties broken by person id."""
    out = rfm_scores(olm, orders, as_of).orderBy(F.col("monetary").desc(), F.col(CUSTOMER).asc())
    return out.limit(limit) if limit is not None else out
