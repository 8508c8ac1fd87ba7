"""Incremental CSV import: each file exactly once, typed by the declared schema."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from decimal import Decimal

from souk.sources.schemas import TABLES
from souk.streaming.ingest import ingest_csv

HEADER = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"


def test_ingest_is_incremental_and_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="souk-stream-", dir=os.environ.get("SOUK_SCRATCH", "/tmp"))
    src, dst, ckpt = (os.path.join(root, d) for d in ("in", "out", "ckpt"))
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as fh:
        fh.write(HEADER + "o1,1,boleto,1,10.50\no1,2,voucher,1,2.00\n")
    q = ingest_csv(spark, "order_payments", src, dst, checkpoint=ckpt)
    q.awaitTermination(120)
    first = spark.read.schema(TABLES["order_payments"]).parquet(dst)
    assert first.count() == 2
    with open(os.path.join(src, "b.csv"), "w") as fh:
        fh.write(HEADER + "o2,1,credit_card,3,99.99\n")
    # Another application (a fresh Python and JVM) goes on with the same checkpoint.
    run = ("import sys; sys.path.insert(0, sys.argv[1])\n"
           "from souk.session import build_session\nfrom souk.streaming.ingest import ingest_csv\n"
           "s = build_session(master='local[2]', shuffle_partitions=2)\n"
           "ingest_csv(s, 'order_payments', *sys.argv[2:4], checkpoint=sys.argv[4]).awaitTermination(120)\n")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", run, repo, src, dst, ckpt], check=True, timeout=240)
    rows = spark.read.schema(TABLES["order_payments"]).parquet(dst).collect()
    assert sorted((r.order_id, r.payment_sequential, r.payment_value) for r in rows) == [
        ("o1", 1, Decimal("10.50")), ("o1", 2, Decimal("2.00")), ("o2", 1, Decimal("99.99"))]
