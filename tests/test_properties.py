"""Randomised checks of the scalar helpers against plain-Python references."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from souk.functions.numeric import round2, whole_days, whole_months


def _months_rule(a: dt.datetime, b: dt.datetime) -> int:
    """Calendar-field rule: 12 * years + months, minus one when b's
    day-and-time within its month is earlier than a's."""
    months = (b.year - a.year) * 12 + (b.month - a.month)
    key = lambda t: (t.day, t.hour, t.minute, t.second, t.microsecond)
    return months - (1 if key(b) < key(a) else 0)


def _pairs(n: int, seed: int = 11):
    rnd = random.Random(seed)
    base = dt.datetime(2016, 1, 1)
    out = []
    for _ in range(n):
        a = base + dt.timedelta(seconds=rnd.randrange(0, 3 * 365 * 86400))
        if rnd.random() < 0.5:                        # many month-end starts
            nxt = (a.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
            a = (nxt - dt.timedelta(days=1)).replace(hour=a.hour, minute=a.minute, second=a.second)
        b = a + dt.timedelta(seconds=rnd.randrange(0, 500 * 86400))
        out.append((a, b))
    return out


def test_whole_months_and_days_match_reference_rules(spark):
    pairs = _pairs(3000)
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    got = df.select("a", "b", whole_months("a", "b").alias("m"), whole_days("a", "b").alias("d")).collect()
    bad = [(r.a, r.b, r.m) for r in got if r.m != _months_rule(r.a, r.b)]
    assert bad == []
    assert all(r.d == (r.b - r.a).days for r in got)


def test_round2_matches_decimal_rounding_of_short_values(spark):
    rnd = random.Random(5)
    xs = [round(rnd.uniform(-1000, 1000), 3) for _ in range(3000)] + [1.005, 2.675, -0.125, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", round2("x").alias("r")).collect()
    expect = {x: float(Decimal(repr(x)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for x in xs}
    assert [r.x for r in got if r.r != expect[r.x]] == []


def test_oracle_month_rule_matches_reference_rule():
    import duckdb

    from souk.plans.oracle import whole_months as sql_months
    pairs = _pairs(3000, seed=12)
    con = duckdb.connect()
    con.execute("CREATE TABLE p (a TIMESTAMP, b TIMESTAMP)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    got = con.execute(f"SELECT a, b, {sql_months('a', 'b')} FROM p").fetchall()
    assert [(a, b, m) for a, b, m in got if m != _months_rule(a, b)] == []
