"""Scalar helpers shared by the operators.

All of them are built-in column expressions, so they stay inside whole-stage
code generation. They encode the few places where the obvious Spark
expression would differ from the reference's SQL semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def round2(c: str | Column) -> Column:
    """``ROUND(x, 2)`` as a DOUBLE, half away from zero on the decimal value.

    Rounding a double directly depends on how each engine treats its binary
    expansion (1.005 is stored as 1.00499...). Going through DECIMAL(38,10)
    first rounds on the printed value and absorbs last-bit differences from
    summation order.
    """
    return F.round(as_double(c).cast("decimal(38,10)"), 2).cast("double")


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``num / NULLIF(den, 0)`` in double. ANSI mode would raise on a zero
    divisor, the reference yields NULL."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def pct(num: str | Column, den: str | Column) -> Column:
    """``100.0 * num / NULLIF(den, 0)``, unrounded."""
    return F.lit(100.0) * as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def zscore(x: str | Column, mean: str | Column, sd: str | Column) -> Column:
    """``ROUND((x - mean) / NULLIF(sd, 0), 2)``: NULL when the spread is zero."""
    return round2((as_double(x) - as_double(mean)) / F.nullif(as_double(sd), F.lit(0.0)))


def whole_days(start: str | Column, end: str | Column) -> Column:
    """``TIMESTAMPDIFF(DAY, start, end)``: whole 24-hour periods, truncated
    toward zero."""
    return F.timestamp_diff("DAY", col(start), col(end))


def calendar_days(end: str | Column, start: str | Column) -> Column:
    """``DATEDIFF(end, start)``: difference of the calendar dates."""
    return F.datediff(col(end).cast("date"), col(start).cast("date"))


def _micros_into_month(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.date_trunc("MONTH", ts), ts)


def whole_months(start: str | Column, end: str | Column) -> Column:
    """``TIMESTAMPDIFF(MONTH, start, end)`` by the calendar-field rule:
    12 * years + months, minus one when the end's day-and-time within its
    month is earlier than the start's. Spark's own month difference differs
    at month ends (Jan 31 -> Feb 28 counts 0 here, as in the reference's
    dialect, but is off in other engines). Valid for end >= start.
    """
    s, e = col(start), col(end)
    months = (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))
    borrow = F.when(_micros_into_month(e) < _micros_into_month(s), 1).otherwise(0)
    return (months - borrow).cast("bigint")


def month_start_text(ts: str | Column) -> Column:
    """``DATE_FORMAT(ts, '%Y-%m-01')``: first day of the month as text."""
    return F.date_format(col(ts), "yyyy-MM-01")


def decimal_text(c: str | Column) -> Column:
    """Text of a value as the reference prints a DECIMAL with two places
    (``12.50``, not ``12.5``)."""
    return col(c).cast("decimal(38,2)").cast("string")
