"""Hand-made fixtures: one case per boundary of the reference's semantics."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import make_tables, money, ts
from pyspark.sql import functions as F

from souk.functions.numeric import round2, whole_months
from souk.operators import actions, categories, cohorts, kpi, quality, rfm, semantic, sellers, states

D = "delivered"


def _olm(t, reviews=True):
    return semantic.order_level_metrics(t["orders"], t["customers"], t["order_payments"],
                                        t["order_reviews"] if reviews else None)


def _cust(cid, uid=None, state="S1"):
    return {"customer_id": cid, "customer_unique_id": uid or cid, "customer_state": state,
            "customer_city": "c"}


def _order(oid, cid, purchase, status=D, delivered=None, estimated=None):
    return {"order_id": oid, "customer_id": cid, "order_status": status,
            "order_purchase_timestamp": ts(purchase) if purchase else None,
            "order_delivered_customer_date": ts(delivered) if delivered else None,
            "order_estimated_delivery_date": ts(estimated) if estimated else None}


def _pay(oid, seq, value):
    return {"order_id": oid, "payment_sequential": seq, "payment_value": money(value),
            "payment_installments": 1, "payment_type": "credit_card"}


def _item(oid, n, seller="s1", product="p1", price="10.00", freight="1.00"):
    return {"order_id": oid, "order_item_id": n, "seller_id": seller, "product_id": product,
            "price": money(price), "freight_value": money(freight)}


# ---------------------------------------------------------------- O3 view

def test_view_experience_payment_and_review(spark):
    t = make_tables(
        spark,
        customers=[_cust("c1"), _cust("c2")],
        orders=[
            _order("o1", "c1", "2018-01-01 10:00:00", delivered="2018-01-05 00:00:00",
                   estimated="2018-01-05 00:00:00"),                       # exactly at estimate
            _order("o2", "c1", "2018-01-01 10:00:00", delivered="2018-01-05 00:00:01",
                   estimated="2018-01-05 00:00:00"),                       # one second late
            _order("o3", "c2", "2018-01-01 10:00:00", estimated="2018-01-05 00:00:00"),
            _order("o4", "missing", "2018-01-01 10:00:00"),                # customer missing
        ],
        order_payments=[_pay("o1", 1, "5.00"), _pay("o1", 2, "7.50"), _pay("o2", 1, "3.00")],
        order_reviews=[{"order_id": "o1", "review_score": 4}],
    )
    rows = {r.order_id: r for r in _olm(t).collect()}
    assert set(rows) == {"o1", "o2", "o3"}
    assert rows["o1"].delivery_experience == semantic.ON_TIME
    assert rows["o2"].delivery_experience == semantic.LATE
    assert rows["o3"].delivery_experience == semantic.UNKNOWN
    assert rows["o1"].payment_value == Decimal("12.50")
    assert rows["o3"].payment_value == 0
    assert rows["o1"].review_score == 4 and rows["o2"].review_score is None
    assert rows["o1"].actual_delivery_days == 3          # 3 days 14 hours: whole days
    assert rows["o3"].actual_delivery_days is None
    assert _olm(t).columns == semantic.COLUMNS


# ---------------------------------------------------------------- O4 / O5

def test_missing_timestamp_count(spark):
    t = make_tables(spark, orders=[_order("o1", "c", None), _order("o2", "c", "2018-01-01 00:00:00")])
    assert quality.missing_timestamp_count(t["orders"]).collect()[0][0] == 1


def test_reconciliation_strictly_more_than_one(spark):
    t = make_tables(
        spark,
        order_items=[_item("a", 1, price="10.00", freight="1.00"), _item("b", 1, price="10.00", freight="1.00"),
                     _item("c", 1, price="10.00", freight="1.00"), _item("c", 2, price="0.01", freight="0.00"),
                     _item("d", 1, price="5.00", freight="0.00"), _item("e", 1)],
        order_payments=[_pay("a", 1, "10.00"),                    # difference exactly 1.00
                        _pay("b", 1, "9.99"),                     # 1.01
                        _pay("c", 1, "6.00"), _pay("c", 2, "6.00"),  # -0.99 ... split payments
                        _pay("d", 1, "6.01")],                    # -1.01; e has no payment
    )
    out = {r.order_id: r.difference for r in
           quality.payment_reconciliation(t["order_items"], t["order_payments"]).collect()}
    assert out == {"b": 1.01, "d": -1.01}


def test_reconciliation_sample_is_ordered_and_limited(spark):
    items = [_item(f"o{i}", 1, price="10.00", freight="0.00") for i in range(15)]
    pays = [_pay(f"o{i}", 1, f"{20 + i}.00") for i in range(15)]
    t = make_tables(spark, order_items=items, order_payments=pays)
    out = quality.payment_reconciliation(t["order_items"], t["order_payments"], limit=10).collect()
    assert [r.order_id for r in out] == [f"o{i}" for i in range(14, 4, -1)]


# ---------------------------------------------------------------- O2

def test_constraint_report_counts_each_breach(spark):
    t = make_tables(
        spark,
        customers=[_cust("c1"), _cust("c1")],
        orders=[_order("o1", "c1", "2018-01-01 00:00:00"), _order("o2", "nobody", "2018-01-01 00:00:00")],
        order_items=[_item("o1", 1, price="-1.00"), _item("o1", 1), _item("o9", 1, seller=None)],
        order_payments=[{"order_id": "o1", "payment_sequential": 0, "payment_value": money("1.00")}],
        order_reviews=[{"order_id": "o1", "review_score": 6}, {"order_id": "o1", "review_score": 2}],
        products=[{"product_id": "p1", "product_weight_g": money("-2.00")}],
    )
    got = {(r.table_name, r.constraint_name): r.violations
           for r in quality.check_constraints(t).collect()}
    assert got[("customers", "pk_customers")] == 1
    assert got[("orders", "fk_orders_customer")] == 1
    assert got[("order_items", "pk_order_items")] == 1
    assert got[("order_items", "fk_order_items_order")] == 1
    assert got[("order_items", "fk_order_items_seller")] == 2        # s1 absent; NULL is no breach
    assert got[("order_items", "fk_order_items_product")] == 0
    assert got[("order_items", "chk_order_items_money_nonnegative")] == 1
    assert got[("order_payments", "chk_order_payments_values")] == 1
    assert got[("order_reviews", "pk_order_reviews")] == 1
    assert got[("order_reviews", "chk_review_score_range")] == 1
    assert got[("products", "chk_products_dimensions_nonnegative")] == 1
    assert len(got) == 30


# ---------------------------------------------------------------- O6

def test_monthly_kpi_lag_skips_gaps_and_zero_revenue(spark):
    t = make_tables(
        spark,
        customers=[_cust("c1"), _cust("c2")],
        orders=[_order("o1", "c1", "2018-01-10 00:00:00"), _order("o2", "c2", "2018-03-10 00:00:00"),
                _order("o3", "c1", "2018-03-11 00:00:00"), _order("o4", "c1", "2018-04-01 00:00:00"),
                _order("o5", "c1", "2018-02-01 00:00:00", status="shipped")],
        order_payments=[_pay("o2", 1, "30.00"), _pay("o3", 1, "10.00"), _pay("o4", 1, "8.00")],
    )
    rows = kpi.monthly_kpi(_olm(t, reviews=False)).collect()
    assert [r.cohort_month for r in rows] == ["2018-01-01", "2018-03-01", "2018-04-01"]
    jan, mar, apr = rows
    assert jan.total_revenue == 0 and jan.prev_month_revenue is None and jan.mom_growth_pct is None
    assert mar.prev_month_revenue == 0 and mar.mom_growth_pct is None       # division by zero -> NULL
    assert mar.total_orders == 2 and mar.active_customers == 2 and mar.aov == 20.0
    assert apr.mom_growth_pct == -80.0


# ---------------------------------------------------------------- numeric helpers

@pytest.mark.parametrize("start,end,months", [
    ("2018-01-31 10:00:00", "2018-02-28 10:00:00", 0),
    ("2017-01-31 23:24:42", "2017-03-01 08:04:08", 1),
    ("2018-01-15 12:00:00", "2018-02-15 11:59:59", 0),
    ("2018-01-15 12:00:00", "2018-02-15 12:00:00", 1),
    ("2018-01-01 00:00:00", "2019-01-01 00:00:00", 12),
    ("2018-01-01 00:00:00", "2019-02-01 00:00:00", 13),
    ("2018-03-10 00:00:00", "2018-03-10 00:00:00", 0),
])
def test_whole_months(spark, start, end, months):
    df = spark.createDataFrame([(ts(start), ts(end))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(whole_months("a", "b")).collect()[0][0] == months


@pytest.mark.parametrize("x,expected", [(1.005, 1.01), (2.675, 2.68), (-1.005, -1.01), (0.125, 0.13),
                                        (12.344999999, 12.34)])
def test_round2_uses_decimal_value(spark, x, expected):
    assert spark.range(1).select(round2(F.lit(x))).collect()[0][0] == expected


# ---------------------------------------------------------------- O8

def test_cohort_month_numbers(spark):
    t = make_tables(
        spark,
        customers=[_cust("c1"), _cust("c2")],
        orders=[_order("a", "c1", "2018-01-31 10:00:00"), _order("b", "c1", "2018-02-28 10:00:00"),
                _order("c", "c1", "2019-01-31 10:00:00"), _order("d", "c1", "2019-02-28 11:00:00"),
                _order("e", "c2", "2018-01-05 00:00:00"), _order("f", "c2", "2018-03-05 00:00:00")],
        order_payments=[_pay(o, 1, "1.00") for o in "abcdef"],
    )
    rows = {(r.cohort_month, r.month_number): r for r in
            cohorts.cohort_retention(_olm(t, reviews=False)).collect()}
    # Jan 31 -> Feb 28 is month 0; the 13-month purchase is cut off.
    assert sorted(rows) == [("2018-01-01", 0), ("2018-01-01", 2), ("2018-01-01", 12)]
    assert rows[("2018-01-01", 0)].retained_customers == 2
    assert rows[("2018-01-01", 0)].cohort_size == 2
    assert rows[("2018-01-01", 0)].retained_revenue == 3.0
    assert rows[("2018-01-01", 12)].retention_pct == 50.0


# ---------------------------------------------------------------- O11

def test_state_labels_and_threshold(spark):
    cs, os_, ps = [], [], []
    spec = {"BIG_LATE": (6, "5.00", True), "BIG_OK": (6, "5.00", False),
            "SMALL_LATE": (4, "1.00", True), "SMALL_OK": (4, "1.00", False), "TINY": (2, "100.00", True)}
    for state, (n, value, late) in spec.items():
        for i in range(n):
            cid = f"{state}-{i}"
            cs.append(_cust(cid, state=state))
            os_.append(_order(cid, cid, "2018-01-01 00:00:00",
                              delivered="2018-01-10 00:00:00" if late else "2018-01-03 00:00:00",
                              estimated="2018-01-05 00:00:00"))
            ps.append(_pay(cid, 1, value))
    reviews = [{"order_id": o["order_id"], "review_score": 2 if o["order_id"].startswith("SMALL_LATE") else 5}
               for o in os_]
    t = make_tables(spark, customers=cs, orders=os_, order_payments=ps, order_reviews=reviews)
    out = {r.customer_state: r.market_action for r in states.state_service_gap(_olm(t), min_orders=4).collect()}
    assert out == {"BIG_LATE": states.PRIORITY, "BIG_OK": states.CORE,
                   "SMALL_LATE": states.WATCH, "SMALL_OK": states.STABLE}


# ---------------------------------------------------------------- O12a

def test_repeat_within_90_days_boundaries(spark):
    t = make_tables(
        spark,
        customers=[_cust(c) for c in ("on1", "on2", "on3", "late1")],
        orders=[
            # exactly 90 days later -> repeat
            _order("a1", "on1", "2018-01-01 10:00:00", delivered="2018-01-02 00:00:00", estimated="2018-01-09 00:00:00"),
            _order("a2", "on1", "2018-04-01 10:00:00"),
            # one second after 90 days -> no repeat
            _order("b1", "on2", "2018-01-01 10:00:00", delivered="2018-01-02 00:00:00", estimated="2018-01-09 00:00:00"),
            _order("b2", "on2", "2018-04-01 10:00:01"),
            # same timestamp, later order id -> repeat
            _order("c1", "on3", "2018-01-01 10:00:00", delivered="2018-01-02 00:00:00", estimated="2018-01-09 00:00:00"),
            _order("c2", "on3", "2018-01-01 10:00:00"),
            # late first order, no repeat
            _order("d1", "late1", "2018-01-01 10:00:00", delivered="2018-02-02 00:00:00", estimated="2018-01-09 00:00:00"),
        ])
    flags = {r.customer_unique_id: r.repeated_within_90d for r in actions.repeat_flags(_olm(t, False)).collect()}
    assert flags == {"on1": 1, "on2": 0, "on3": 1, "late1": 0}
    gap = actions.repeat_rate_gap(_olm(t, False)).collect()[0][0]
    assert gap == round(100 * 2 / 3 - 0, 2)


def test_repeat_gap_is_zero_with_one_side_missing(spark):
    t = make_tables(spark, customers=[_cust("c")],
                    orders=[_order("a", "c", "2018-01-01 00:00:00", delivered="2018-01-02 00:00:00",
                                   estimated="2018-01-09 00:00:00")])
    assert actions.repeat_rate_gap(_olm(t, False)).collect()[0][0] == 0.0


# ---------------------------------------------------------------- O9 / O12c

def test_seller_threshold_spread_and_late_denominator(spark):
    orders, items = [], []
    for i in range(30):                       # s30: 30 delivered orders, 10 of them late
        late = i < 10
        orders.append(_order(f"x{i}", "c", "2018-01-01 00:00:00",
                             delivered="2018-01-10 00:00:00" if late else "2018-01-03 00:00:00",
                             estimated="2018-01-05 00:00:00"))
        items.append(_item(f"x{i}", 1, seller="s30"))
    for i in range(29):                       # s29: one order short of the threshold
        orders.append(_order(f"y{i}", "c", "2018-01-01 00:00:00", delivered="2018-01-03 00:00:00",
                             estimated="2018-01-05 00:00:00"))
        items.append(_item(f"y{i}", 1, seller="s29"))
    for i in range(10):                       # cancelled items of s30 dilute its late rate only
        orders.append(_order(f"z{i}", "c", "2018-01-01 00:00:00", status="canceled"))
        items.append(_item(f"z{i}", 1, seller="s30"))
    t = make_tables(spark, orders=orders, order_items=items,
                    sellers=[{"seller_id": "s30", "seller_state": "A"}, {"seller_id": "s29", "seller_state": "B"}])
    rows = sellers.seller_risk(t["order_items"], t["orders"], t["sellers"], t["order_reviews"]).collect()
    assert [r.seller_id for r in rows] == ["s30"]
    r = rows[0]
    assert r.delivered_orders == 30 and r.gmv == 330.0
    assert r.late_delivery_rate_pct == 25.0          # 10 late of 40 items of any status
    assert r.avg_delivery_days == round((10 * 9 + 20 * 2) / 30, 2)
    assert r.late_rate_z_score is None                # one seller: zero spread
    assert r.avg_review_score is None                 # no reviews
    assert r.gmv_share_pct == 100.0 and r.cumulative_gmv_share_pct == 100.0


def test_seller_pareto_first_rank_reaching_target(spark):
    orders = [_order(f"o{i}", "c", "2018-01-01 00:00:00") for i in range(5)]
    amounts = ["50.00", "30.00", "10.00", "5.00", "5.00"]
    items = [_item(f"o{i}", 1, seller=f"s{i}", price=a, freight="0.00") for i, a in enumerate(amounts)]
    t = make_tables(spark, orders=orders, order_items=items)
    assert sellers.seller_pareto(t["order_items"], t["orders"]).collect()[0][0] == 40.0


# ---------------------------------------------------------------- O10 / O12d

def test_category_labels_and_alert_count(spark):
    products = [{"product_id": "p_margin", "product_category_name": "m"},
                {"product_id": "p_price80", "product_category_name": "x"},
                {"product_id": "p_nocat", "product_category_name": None},
                {"product_id": "p_untranslated", "product_category_name": "raw"}]
    translation = [{"product_category_name": "m", "product_category_name_english": "Margin"},
                   {"product_category_name": "x", "product_category_name_english": "Pricey"}]
    orders, items = [], []
    spec = [("p_margin", "79.99", "32.00"),     # ratio 40.005 -> 40.01, price < 80
            ("p_price80", "80.00", "32.00"),    # ratio 40.00, price not < 80
            ("p_nocat", "100.00", "1.00"),
            ("p_untranslated", "100.00", "1.00")]
    for p, price, freight in spec:
        for i in range(3):
            oid = f"{p}-{i}"
            orders.append(_order(oid, "c", "2018-01-01 00:00:00", delivered="2018-01-02 00:00:00",
                                 estimated="2018-01-05 00:00:00"))
            items.append(_item(oid, 1, product=p, price=price, freight=freight))
    t = make_tables(spark, orders=orders, order_items=items, products=products,
                    product_category_name_translation=translation)
    out = {r.category_name: r for r in categories.category_economics(
        t["order_items"], t["orders"], t["products"], t["product_category_name_translation"],
        t["order_reviews"], min_orders=3).collect()}
    assert set(out) == {"Margin", "Pricey", None, "raw"}
    assert out["Margin"].category_action == categories.MARGIN
    assert out["Pricey"].category_action == categories.CORE     # price 80.00 is not < 80
    assert out["Pricey"].freight_to_revenue_pct == 40.0
    alerts = categories.category_alerts(t["order_items"], t["orders"], t["products"],
                                        t["product_category_name_translation"], min_orders=3)
    assert alerts.collect()[0][0] == 2


# ---------------------------------------------------------------- O7

def test_rfm_scores_are_tiles_with_id_tie_break(spark):
    cs = [_cust(f"c{i}") for i in range(10)]
    orders = [_order(f"o{i}", f"c{i}", f"2018-01-{i + 1:02d} 00:00:00") for i in range(10)]
    orders.append(_order("later", "c9", "2018-01-20 00:00:00"))
    pays = [_pay(f"o{i}", 1, f"{(i + 1) * 10}.00") for i in range(10)] + [_pay("later", 1, "1.00")]
    t = make_tables(spark, customers=cs, orders=orders, order_payments=pays)
    out = {r.customer_unique_id: r for r in
           rfm.rfm_segments(_olm(t, False), t["orders"], limit=None).collect()}
    assert len(out) == 10
    assert out["c9"].frequency == 2 and out["c9"].recency == 0
    assert out["c9"].r_score == 5 and out["c9"].f_score == 5 and out["c9"].m_score == 5
    assert out["c9"].segment == rfm.CHAMPIONS
    # nine customers tie on frequency 1: ids decide, c0..c1 first tile
    assert out["c0"].f_score == 1 and out["c1"].f_score == 1 and out["c6"].f_score == 4 and out["c8"].f_score == 5
    assert out["c0"].r_score == 1 and out["c0"].segment == rfm.GENERAL
    top = rfm.rfm_segments(_olm(t, False), t["orders"], limit=3).collect()
    assert [r.customer_unique_id for r in top] == ["c9", "c8", "c7"]


# ---------------------------------------------------------------- O12

def test_action_board_text_and_branches(spark):
    cs = [_cust(f"c{i}") for i in range(5)]
    orders = [_order(f"o{i}", f"c{i}", "2018-01-01 00:00:00", delivered="2018-01-02 00:00:00",
                     estimated="2018-01-05 00:00:00") for i in range(5)]
    pays = [_pay(f"o{i}", 1, v) for i, v in enumerate(["1.00", "1.00", "1.00", "1.00", "96.00"])]
    items = [_item(f"o{i}", 1, seller=f"s{i}", product="p1", price="10.00", freight="5.00") for i in range(5)]
    t = make_tables(spark, customers=cs, orders=orders, order_payments=pays, order_items=items,
                    products=[{"product_id": "p1", "product_category_name": "k"}])
    board = actions.action_board(_olm(t, False), t["order_items"], t["orders"], t["products"],
                                 t["product_category_name_translation"]).collect()
    got = {r.initiative: (r.priority, r.evidence, r.recommendation) for r in board}
    assert got[actions.REPEAT_INITIATIVE] == (
        "P1", "90-day repeat-rate gap between on-time and late first orders: 0.00 pp", actions.REPEAT_KEEP)
    assert got[actions.VIP_INITIATIVE] == ("P1", "Top revenue quintile contributes 96.00% of delivered revenue",
                                           actions.VIP_ACT)
    assert got[actions.SELLER_INITIATIVE] == ("P1", "80.00% of sellers generate 80% of delivered GMV",
                                              actions.SELLER_KEEP)
    assert got[actions.CATEGORY_INITIATIVE] == ("P2", "0 categories exceed a 40% freight-to-revenue ratio",
                                                actions.CATEGORY_KEEP)


# ---------------------------------------------------------------- empty input

def test_empty_tables_give_empty_or_null_results(spark):
    t = make_tables(spark)
    olm = _olm(t)
    assert kpi.monthly_kpi(olm).count() == 0
    assert cohorts.cohort_retention(olm).count() == 0
    assert states.state_service_gap(olm).count() == 0
    assert sellers.seller_risk(t["order_items"], t["orders"], t["sellers"], t["order_reviews"]).count() == 0
    assert rfm.rfm_segments(olm, t["orders"]).count() == 0
    board = actions.action_board(olm, t["order_items"], t["orders"], t["products"],
                                 t["product_category_name_translation"]).collect()
    assert len(board) == 4
    assert quality.check_constraints(t).filter("violations > 0").count() == 0


def test_rfm_reference_date_defaults_to_latest_purchase_of_any_status(spark):
    import datetime as dt
    t = make_tables(
        spark,
        customers=[_cust("c1"), _cust("c2")],
        orders=[_order("o1", "c1", "2018-01-01 23:00:00"),
                _order("o2", "c2", "2018-01-05 01:00:00", status="shipped")],   # not delivered, sets the date
        order_payments=[_pay("o1", 1, "5.00")])
    rows = rfm.rfm_segments(_olm(t, False), t["orders"]).collect()
    assert [(r.customer_unique_id, r.recency) for r in rows] == [("c1", 4)]    # calendar days
    fixed = rfm.rfm_segments(_olm(t, False), t["orders"], as_of=dt.datetime(2018, 1, 31)).collect()
    assert fixed[0].recency == 30
