"""The queries that SQL can express against DuckDB, on whole tables."""

import duckdb
import pytest

from postmill.llm.oracle import STATEMENTS
from postmill.llm.queries import QUERIES

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", STATEMENTS)
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    answer = con.execute(STATEMENTS[name])
    columns = sorted(c[0] for c in answer.description)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({STATEMENTS[name]})").fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, sf).select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
