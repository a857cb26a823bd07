"""Every registered query against its SQL in DuckDB, over whole tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import SF

OWN = sorted(n for n in entry.queries() if not (n == "pipeline" or n.startswith("op") and n[2:3].isdigit()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(value):
    if pd.isna(value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat().removesuffix("T00:00:00")
    return str(value)


def rows(frame, columns):
    return sorted(tuple(plain(x.item() if hasattr(x, "item") else x) for x in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert [[x.removesuffix(" 00:00:00") for x in r] for r in rows(got, columns)] == [[x.removesuffix(" 00:00:00") for x in r] for r in rows(want, columns)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
