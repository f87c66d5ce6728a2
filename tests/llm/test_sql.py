"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tessera.llm import queries

from .conftest import DATA


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
