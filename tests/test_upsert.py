"""Reviews under their key from files in any order; cohort matrix and partition overwrite."""

from __future__ import annotations

import itertools

import pytest
from conftest import make_tables, ts

from souk.operators.cohorts import cohort_matrix
from souk.sources.loader import dedupe_reviews
from souk.sources.sinks import overwrite_partitions, read_partitions
from souk.streaming.upsert import committed_batches, merge_batch, read_reviews, upsert_reviews


def review(k, order, answer, score=3):
    return {"review_id": f"r{k}", "order_id": order, "review_score": score,
            "review_answer_timestamp": answer and ts(f"2018-01-{answer:02d} 00:00:00")}


FILES = [[review(1, "a", 5), review(2, "b", None)], [review(3, "a", 2), review(4, "c", 1)],
         [review(5, "b", None), review(6, "a", 5)]]


def as_set(df):
    return sorted((r.order_id, r.review_id, r.review_score) for r in df.collect())


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_any_order_equals_the_batch_load(spark, tmp_path, order):
    frames = [make_tables(spark, order_reviews=f)["order_reviews"] for f in FILES]
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    target = f"{tmp_path}/t"
    assert read_reviews(spark, target).collect() == []
    for n, k in enumerate(order):
        merge_batch(frames[k], n, target, parts=4)
    assert as_set(read_reviews(spark, target)) == as_set(dedupe_reviews(whole)) == [("a", "r6", 3), ("b", "r5", 3), ("c", "r4", 3)]


def test_batch_that_runs_again(spark, tmp_path):
    frames = [make_tables(spark, order_reviews=f)["order_reviews"] for f in FILES]
    target = f"{tmp_path}/t"
    for n, k in [(0, 0), (1, 1), (1, 1), (0, 0), (2, 2), (3, 1), (2, 2)]:      # replays, and a file sent twice
        merge_batch(frames[k], n, target, parts=4)
    assert as_set(read_reviews(spark, target)) == [("a", "r6", 3), ("b", "r5", 3), ("c", "r4", 3)]
    import os
    os.remove(f"{target}/batch=2/_SUCCESS")                                    # an unfinished batch does not count
    assert committed_batches(spark, target) == [0, 1, 3]


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    head = "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
    (source / "one.csv").write_text(head + 'r1,a,5,,"x\ny",,2018-01-02 00:00:00\n')
    run = lambda: upsert_reviews(spark, str(source), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination(120)
    run()
    (source / "two.csv").write_text(head + "r0,a,1,,,,2018-01-01 00:00:00\nr2,b,4,,,,\n")
    run()
    run()
    assert as_set(read_reviews(spark, f"{tmp_path}/t")) == [("a", "r1", 5), ("b", "r2", 4)]


def test_rerun_of_one_month_leaves_others(spark, tmp_path):
    tall = spark.createDataFrame([("2018-01", 0, 100.0), ("2018-01", 2, 5.0), ("2018-02", 0, 100.0)],
                                 "cohort_month string, month_number long, retention_pct double")
    path = f"{tmp_path}/cohorts"
    overwrite_partitions(tall, path, ["cohort_month"])
    again = spark.createDataFrame([("2018-02", 0, 100.0), ("2018-02", 1, 7.0)], tall.schema)
    overwrite_partitions(again, path, ["cohort_month"])
    got = read_partitions(spark, path, tall.schema)
    assert got.schema == tall.schema
    wide = {r.cohort_month: r for r in cohort_matrix(got, 2).collect()}
    assert wide["2018-01"][1:] == (100.0, None, 5.0) and wide["2018-02"][1:] == (100.0, 7.0, None)


def test_reviews_are_rewritten_seldom(spark, tmp_path):
    """Eight batches of one order each: 20 rows are written in all, not 36."""
    target = f"{tmp_path}/t"
    for n in range(8):
        merge_batch(make_tables(spark, order_reviews=[review(n, f"o{n}", 1)])["order_reviews"], n, target, parts=1)
        assert as_set(read_reviews(spark, target)) == [(f"o{k}", f"r{k}", 3) for k in range(n + 1)]
    assert sum(spark.read.parquet(f"{target}/batch={n}").count() for n in range(8)) == 20


def test_folders_of_parts_are_still_read(spark, tmp_path):
    """Batches written as whole parts (``batch=b/part=p``) count with the runs after them."""
    target = f"{tmp_path}/t"
    for n, (part, rows) in enumerate([(0, [review(1, "a", 5)]), (1, [review(2, "b", 1)]), (1, [review(2, "b", 1), review(3, "d", 1)])]):
        make_tables(spark, order_reviews=rows)["order_reviews"].write.parquet(f"{target}/batch={n}/part={part}")
        (tmp_path / "t" / f"batch={n}" / "_SUCCESS").touch()
    assert as_set(read_reviews(spark, target)) == [("a", "r1", 3), ("b", "r2", 3), ("d", "r3", 3)]
    merge_batch(make_tables(spark, order_reviews=[review(4, "b", 2)])["order_reviews"], 3, target)
    assert as_set(read_reviews(spark, target)) == [("a", "r1", 3), ("b", "r4", 3), ("d", "r3", 3)]
