"""The order-level view from changes alone equals the view of the whole tables."""

from __future__ import annotations

import os
import random

import pytest
from conftest import make_tables, money, ts
from pyspark.sql import functions as F

from souk.operators.semantic import order_level_metrics
from souk.sources.loader import dedupe_reviews
from souk.streaming.view_refresh import NONE, newest_parts, read_view, refresh_view


def order(k, customer, month, status="shipped", delivered=None):
    return {"order_id": k, "customer_id": customer, "order_status": status,
            "order_purchase_timestamp": month and ts(f"2018-{month:02d}-03 10:00:00"),
            "order_delivered_customer_date": delivered and ts(delivered), "order_estimated_delivery_date": ts("2018-03-20 00:00:00")}


def person(k, state="SP"):
    return {"customer_id": k, "customer_unique_id": "p" + k, "customer_state": state, "customer_city": state.lower()}


def paid(k, seq, value):
    return {"order_id": k, "payment_sequential": seq, "payment_type": "card", "payment_installments": 1, "payment_value": money(value)}


def review(k, order_id, score, answer=None):
    return {"review_id": k, "order_id": order_id, "review_score": score, "review_answer_timestamp": answer and ts(answer)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark, **rows):
    withdrawn = rows.pop("order_payments_withdrawn", None)
    made = make_tables(spark, **rows)
    out = {k: made[k] for k in rows}
    if withdrawn is not None:
        out["order_payments_withdrawn"] = make_tables(spark, order_payments=withdrawn)["order_payments"]
    return out


def test_changes_one_by_one(spark, tmp_path):
    target = f"{tmp_path}/v"
    people = [person("c1"), person("c2")]
    now = lambda: make_tables(spark, customers=people)["customers"]
    assert read_view(spark, target).collect() == []
    load = frames(spark, orders=[order("a", "c1", 1), order("b", "c2", 2), order("u", "c1", None), order("x", "nobody", 1)],
                  order_payments=[paid("a", 1, "5.00"), paid("a", 2, "2.50"), paid("later", 1, "9.00")],
                  order_reviews=[review("r1", "a", 4), review("r0", "a", 1)])
    lost = spark.createDataFrame([(None, 1, money("1.00"))], "order_id string, part int, payment_value decimal(12,2)")
    load["order_payments"] = load["order_payments"].withColumn("part", F.lit(1)).unionByName(lost, allowMissingColumns=True)
    assert refresh_view(load, now(), target, 0) == ["2018-01", "2018-02", NONE]
    got = {r["order_id"]: r for r in read_view(spark, target).collect()}
    assert sorted(got) == ["a", "b", "u"]                              # x has no customer, later has no order
    assert (got["a"]["payment_value"], got["a"]["review_score"], got["b"]["payment_value"]) == (money("7.50"), 4, money("0.00"))

    # An order comes after its payment; another is delivered; a payment is withdrawn: February stays.
    change = frames(spark, orders=[order("later", "c2", 3), order("a", "c1", 1, "delivered", "2018-01-09 12:00:00")],
                    order_payments_withdrawn=[paid("a", 2, "2.50")], order_reviews=[review("q", "a", 2, "2018-02-01 00:00:00")])
    for _ in range(2):                                                 # a second run writes the same
        assert refresh_view(change, now(), target, 1) == ["2018-01", "2018-03", NONE]
        got = {r["order_id"]: r for r in read_view(spark, target).collect()}
        assert (got["later"]["payment_value"], got["later"]["customer_unique_id"]) == (money("9.00"), "pc2")
        assert (got["a"]["payment_value"], got["a"]["review_score"], got["a"]["actual_delivery_days"]) == (money("5.00"), 2, 6)
    assert newest_parts(spark, target)["2018-02"].endswith("batch=0/part=2018-02")

    # The undated order gets a date, the only order of March another month, and its old part is empty.
    change = frames(spark, orders=[order("u", "c1", 2), order("later", "c2", 2)])
    assert refresh_view(change, now(), target, 2) == ["2018-02", "2018-03", NONE]
    assert sorted(r["order_id"] for r in read_view(spark, target).collect()) == ["a", "b", "later", "u"]

    # A customer moves, another becomes known.
    people[0] = person("c1", "RJ")
    people.append(person("nobody"))
    change = frames(spark, customers=[people[0], people[2]])
    assert refresh_view(change, now(), target, 3) == ["2018-01", "2018-02", NONE]
    got = {r["order_id"]: r["customer_state"] for r in read_view(spark, target).collect()}
    assert got == {"a": "RJ", "b": "SP", "later": "SP", "u": "RJ", "x": "SP"}

    # An unfinished refresh does not count; an empty change rewrites one part.
    os.remove(f"{target}/batch=3/_SUCCESS")
    assert {r["customer_state"] for r in read_view(spark, target).collect()} == {"SP"}
    assert refresh_view({}, now(), target, 4) == [NONE]
    with pytest.raises(ValueError):
        refresh_view({"sellers": now()}, now(), target, 5)


def test_random_changes_equal_the_recomputed_view(spark, tmp_path):
    rng = random.Random(5)
    target = f"{tmp_path}/v"
    people = {f"c{k}": person(f"c{k}") for k in range(6)}
    orders, payments, reviews = {}, [], []
    for n in range(4):
        change = {"orders": {}, "order_payments": [], "order_payments_withdrawn": [], "order_reviews": [], "customers": {}}
        for _ in range(12):
            k = f"o{rng.randrange(25)}"
            change["orders"][k] = order(k, f"c{rng.randrange(7)}", rng.choice([None, 1, 2, 3, 4]), rng.choice(["shipped", "delivered"]),
                                        rng.choice([None, "2018-03-19 01:00:00", "2018-05-01 00:00:00"]))
            change["order_payments"].append(paid(f"o{rng.randrange(25)}", 100 * n + len(payments), f"{rng.randrange(900)}.37"))
            change["order_reviews"].append(review(f"r{rng.randrange(99)}", f"o{rng.randrange(25)}", rng.randrange(1, 6),
                                                  rng.choice([None, "2018-02-01 00:00:00", "2018-02-02 00:00:00"])))
        for p in rng.sample(payments, min(3, len(payments))):
            payments.remove(p)
            change["order_payments_withdrawn"].append(p)
        c = f"c{rng.randrange(7)}"
        change["customers"][c] = people[c] = person(c, rng.choice(["RJ", "MG"]))
        orders |= change["orders"]
        payments += change["order_payments"]
        # One review id has one score.
        change["order_reviews"] = [r | {"review_score": 1 + int(r["review_id"][1:]) % 5} for r in change["order_reviews"]]
        reviews += change["order_reviews"]
        change = {k: list(v.values()) if isinstance(v, dict) else v for k, v in change.items()}
        t = make_tables(spark, orders=list(orders.values()), order_payments=payments, order_reviews=reviews, customers=list(people.values()))
        refresh_view(frames(spark, **change), t["customers"], target, n)
        want = order_level_metrics(t["orders"], t["customers"], t["order_payments"], dedupe_reviews(t["order_reviews"]))
        assert rows_of(read_view(spark, target)) == rows_of(want)
    assert read_view(spark, target).columns == want.columns
