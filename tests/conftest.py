from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from souk.session import build_session  # noqa: E402
from souk.sources.schemas import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="souk-tests")
    yield s


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def money(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


def _row(table: str, values: dict):
    unknown = set(values) - set(TABLES[table].fieldNames())
    assert not unknown, f"{table}: unknown columns {unknown}"
    return tuple(values.get(f) for f in TABLES[table].fieldNames())


def make_tables(spark, **rows):
    """The nine tables from dicts (missing tables and columns are empty/NULL)."""
    return {name: spark.createDataFrame([_row(name, r) for r in rows.get(name, [])], schema)
            for name, schema in TABLES.items()}
