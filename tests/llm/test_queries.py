"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import os

import duckdb
import pytest

from corvane.llm import queries
from tests.test_catalogue import canonical


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, con, name):
    got = queries.queries()[name](spark, data).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    if name.endswith("_found"):
        assert not got.duplicated().any()
