"""Equal texts under the collation get one spelling."""

from __future__ import annotations

from conftest import make_tables

from souk.functions.collation import collate_tables, spellings


def test_classes_and_their_spelling(spark):
    words = ["São Paulo", "sao paulo  ", "SAO PAULO", "sao  paulo", " sao paulo", "Rio", "rió", None, "", "  ", "straße", "STRASSE"]
    df = spark.createDataFrame([(w,) for w in words for _ in range(3)], "state string")
    got = {r.spelling: r.canonical for r in spellings(df).collect()}
    assert None not in got and len(got) == len(set(words)) - 1
    assert {got[w] for w in ("São Paulo", "sao paulo  ", "SAO PAULO")} == {"SAO PAULO"}
    assert got["sao  paulo"] == "sao  paulo" and got[" sao paulo"] == " sao paulo"
    assert got["rió"] == "Rio" and got["  "] == ""
    assert {r.canonical for r in spellings(df, ["são paulo"]).filter("spelling = 'SAO PAULO'").collect()} == {"são paulo"}
    assert spellings(df.limit(0)).collect() == []


def test_tables(spark):
    t = make_tables(spark, orders=[{"order_id": f"o{k}", "customer_id": "c", "order_status": s}
                                   for k, s in enumerate(["delivered", "DELIVERED ", "Delivéred", "shipped", None])],
                    customers=[{"customer_id": "c", "customer_unique_id": "u", "customer_state": "sp "}],
                    sellers=[{"seller_id": "s", "seller_state": "SP"}],
                    products=[{"product_id": "p", "product_category_name": "Beleza Saúde"}],
                    product_category_name_translation=[{"product_category_name": "BELEZA SAUDE ",
                                                        "product_category_name_english": "beauty"}])
    got = collate_tables(t)
    assert sorted(str(r.order_status) for r in got["orders"].collect()) == ["None", "delivered", "delivered", "delivered", "shipped"]
    assert got["customers"].collect()[0].customer_state == got["sellers"].collect()[0].seller_state == "SP"
    assert got["products"].join(got["product_category_name_translation"], "product_category_name").count() == 1
    assert all(got[n].columns == t[n].columns for n in t)
