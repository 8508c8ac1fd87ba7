"""CSV import in parallel: records across splits, quotes, line ends, rejects."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from souk.sources import csv_records
from souk.sources.loader import CSV_OPTIONS, load_tables

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def make(rng, rows, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "a", "b"])
    bits = ["x", "yz", '"', '""', ",", "\n", "\r\n", " ", "é", '",', "\n\n", "long words here "]
    for k in range(rows):
        w.writerow([k, "".join(rng.choice(bits) for _ in range(rng.choice((0, 2, 9, 40)))), "".join(rng.choice(bits) for _ in range(3))])
    return out.getvalue()


@pytest.mark.parametrize(("end", "broadcast"), [("\n", 50_000), ("\r\n", 50_000), ("\n", 0)])
def test_equals_python_reader(spark, tmp_path, small_splits, monkeypatch, end, broadcast):
    monkeypatch.setattr(csv_records, "BROADCAST_SPLITS", broadcast)
    rng, want = random.Random(len(end) + broadcast), []
    for k in range(3):
        text = make(rng, 150, end)
        (tmp_path / f"part-{k}.csv").write_text(text, newline="")
        want += [(int(i), a, b) for i, a, b in list(csv.reader(io.StringIO(text, newline="")))[1:]]
    lines = csv_records.read_lines(spark, str(tmp_path))
    states = csv_records.split_states(lines).collect()
    assert len(states) > 12 and lines.rdd.getNumPartitions() > 3              # more tasks than files
    assert any(s.begins_inside for s in states) and any(not s.begins_inside for s in states)
    got = csv_records.import_csv(spark, SCHEMA, str(tmp_path))
    assert got.rejects.count() == 0
    assert sorted((r.id, r.a or "", r.b or "") for r in got.rows.collect()) == sorted(want)


def test_record_over_many_splits_and_one_wide_file(spark, tmp_path, small_splits):
    long = "line, with \"quotes\"\n" * 400
    text = 'id,a,b\n1,"' + long.replace('"', '""') + '",x\n2,,"y"\n\n3,"p\nq",\n'
    (tmp_path / "one.csv").write_text(text, newline="")
    rows = {r.id: (r.a, r.b) for r in csv_records.import_csv(spark, SCHEMA, str(tmp_path / "one.csv")).rows.collect()}
    assert rows == {1: (long, "x"), 2: (None, "y"), 3: ("p\nq", None)}


def test_bad_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,a,b\n1,x,y\nfive,x,y\n2,"s\nt",u\n3,short\n4,x,y,more\n')
    got = csv_records.import_csv(spark, SCHEMA, str(tmp_path / "t.csv"))
    assert sorted(r.id for r in got.rows.collect()) == [1, 2]
    assert sorted(r.record for r in got.rejects.collect()) == ["3,short", "4,x,y,more", "five,x,y"]


def test_same_as_the_engines_own_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,a,b\n1,"",\n2, pad ,"q""q"\n3,"a\nb","c\r\nd"\n\n4,,"\n"\n', newline="")
    ours = csv_records.import_csv(spark, SCHEMA, str(tmp_path / "t.csv")).rows.collect()
    theirs = spark.read.schema(SCHEMA).options(**CSV_OPTIONS).csv(str(tmp_path / "t.csv")).collect()
    assert sorted(ours, key=str) == sorted(theirs, key=str)


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,a,b\n")
    got = csv_records.import_csv(spark, SCHEMA, str(tmp_path))
    assert got.rows.collect() == [] and got.rejects.collect() == []


def test_load_fails_or_reports(spark, tmp_path):
    from souk.sources.schemas import TABLES

    for name, schema in TABLES.items():
        (tmp_path / f"{name}.csv").write_text(",".join(schema.fieldNames()) + "\n")
    (tmp_path / "order_payments.csv").write_text(
        "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,boleto,1,12.50\no2,one,boleto,1,3\n")
    with pytest.raises(ValueError, match="order_payments"):
        load_tables(spark, str(tmp_path), "csv")
    rejects = {}
    tables = load_tables(spark, str(tmp_path), "csv", rejects=rejects)
    assert [r.order_id for r in tables["order_payments"].collect()] == ["o1"]
    assert [r.record for r in rejects["order_payments"].collect()] == ["o2,one,boleto,1,3"]
    assert rejects["orders"].count() == 0


def test_records_of_batches_of_any_length(spark, tmp_path, small_splits):
    """Records that cross batches, splits and files come out the same however the lines are dealt."""
    rng, want = random.Random(5), []
    for k in range(2):
        text = make(rng, 60, "\n")
        (tmp_path / f"part-{k}.csv").write_text(text, newline="")
        want += [(int(i), a, b) for i, a, b in list(csv.reader(io.StringIO(text, newline="")))[1:]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "3", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = csv_records.import_csv(spark, SCHEMA, str(tmp_path)).rows.collect()
            assert sorted((r.id, r.a or "", r.b or "") for r in got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
