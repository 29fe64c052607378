"""Every registered query against its SQL twin on the small tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

ORACLE = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def cell(value):
    if isinstance(value, (float, decimal.Decimal)) or (isinstance(value, int) and not isinstance(value, bool)):
        return f"{float(value):.6f}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, sf, duck, name):
    df = driver.queries()[name](spark, sf)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, got) == table(want.columns, want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
