"""O1 loading: CSV parsing, declared types, review dedupe, normalising option."""

from __future__ import annotations

import os
import tempfile
from decimal import Decimal

from conftest import make_tables, ts

from souk.sources.loader import dedupe_reviews, load_tables, normalise
from souk.sources.schemas import TABLES

REVIEWS_CSV = (
    'review_id,order_id,review_score,review_comment_title,review_comment_message,'
    'review_creation_date,review_answer_timestamp\n'
    'r1,o1,5,,"line one\nline two",2018-01-02 00:00:00,2018-01-03 10:11:12\n'
    'r2,o2,1,"say ""hi""",,2018-01-02 00:00:00,\n'
)


def _write(folder: str, table: str, text: str) -> None:
    with open(os.path.join(folder, f"{table}.csv"), "w") as fh:
        fh.write(text)


def test_csv_multiline_quotes_and_empty_fields(spark):
    folder = tempfile.mkdtemp(prefix="souk-csv-", dir=os.environ.get("SOUK_SCRATCH", "/tmp"))
    for name, schema in TABLES.items():
        _write(folder, name, ",".join(schema.fieldNames()) + "\n")
    _write(folder, "order_reviews", REVIEWS_CSV)
    _write(folder, "order_payments",
           "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,boleto,1,12.50\n")
    t = load_tables(spark, folder, "csv")
    rows = {r.review_id: r for r in t["order_reviews"].collect()}
    assert rows["r1"].review_comment_message == "line one\nline two"
    assert rows["r1"].review_comment_title is None
    assert rows["r2"].review_comment_title == 'say "hi"'
    assert rows["r1"].review_answer_timestamp == ts("2018-01-03 10:11:12")
    assert rows["r2"].review_answer_timestamp is None
    assert t["order_payments"].collect()[0].payment_value == Decimal("12.50")
    assert t["orders"].schema == TABLES["orders"] or \
        [f.dataType for f in t["orders"].schema] == [f.dataType for f in TABLES["orders"]]


def test_dedupe_keeps_latest_answer_then_greatest_id(spark):
    t = make_tables(spark, order_reviews=[
        {"review_id": "a", "order_id": "o1", "review_score": 1, "review_answer_timestamp": ts("2018-01-01 00:00:00")},
        {"review_id": "b", "order_id": "o1", "review_score": 5, "review_answer_timestamp": ts("2018-02-01 00:00:00")},
        {"review_id": "c", "order_id": "o2", "review_score": 2, "review_answer_timestamp": None},
        {"review_id": "d", "order_id": "o2", "review_score": 3, "review_answer_timestamp": None},
    ])
    out = {r.order_id: (r.review_id, r.review_score) for r in dedupe_reviews(t["order_reviews"]).collect()}
    assert out == {"o1": ("b", 5), "o2": ("d", 3)}
    assert dedupe_reviews(t["order_reviews"]).columns == t["order_reviews"].columns


def test_normalise_status_state_and_category(spark):
    t = make_tables(spark,
                    orders=[{"order_id": "o", "customer_id": "c", "order_status": " Delivered "}],
                    customers=[{"customer_id": "c", "customer_unique_id": "u", "customer_state": "sp "}],
                    products=[{"product_id": "p", "product_category_name": "Beleza "}],
                    product_category_name_translation=[{"product_category_name": "beleza",
                                                        "product_category_name_english": "beauty"}])
    n = normalise(t)
    assert n["orders"].collect()[0].order_status == "delivered"
    assert n["customers"].collect()[0].customer_state == "SP"
    assert n["products"].collect()[0].product_category_name == "beleza"


def test_sinks_round_trip_and_views(spark):
    from souk.sources.sinks import register_views, save_tables, write_table
    folder = tempfile.mkdtemp(prefix="souk-sink-", dir=os.environ.get("SOUK_SCRATCH", "/tmp"))
    t = make_tables(spark, orders=[{"order_id": "o1", "customer_id": "c1", "order_status": "delivered"}])
    save_tables(t, folder)
    back = load_tables(spark, folder, "parquet", unique_reviews=False)
    assert back["orders"].collect()[0].order_id == "o1"
    write_table(back["orders"], os.path.join(folder, "tall"), partition_by=["order_status"])
    assert spark.read.parquet(os.path.join(folder, "tall")).count() == 1
    register_views(spark, {"souk_test_orders": back["orders"]})
    assert spark.sql("SELECT count(*) FROM souk_test_orders").collect()[0][0] == 1


def test_cluster_without_checkpoint_dir_is_an_error():
    import pytest
    from types import SimpleNamespace

    from souk import session

    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"),
                           conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake)
    assert not session.is_single_process("local-cluster[2,1,512]") and session.is_single_process("local[*]")


def test_staged_folders_are_dropped(spark):
    from souk.sources import staging

    kept, gone = (staging.stage(spark.range(10), "t") for _ in range(2))
    folder = os.path.dirname(gone.inputFiles()[0].split(":", 1)[1].replace("///", "/"))
    assert os.path.isdir(folder)
    staging.drop_staged(gone)
    assert not os.path.exists(folder) and kept.count() == 10
    staging.drop_staged(kept)
