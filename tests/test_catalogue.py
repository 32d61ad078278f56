"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registry
from corvane.plans import catalogue
from corvane.streaming import budget

NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "NULL" if v is None or (not isinstance(v, list) and pd.isna(v)) else f"{float(v):.6g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, con, name):
    got = catalogue.queries()[name](spark, data).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry_and_registration(spark):
    assert set(NAMES) <= set(registry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).columns == ["canonical", "docs", "mentions"]


def test_admission_stream(spark, tmp_path):
    """A key's requests are admitted while the last minute has room."""
    rows = [(i, f"2024-01-01 00:00:{i * 10:02d}", 1, "t", 40.0, "{}") for i in range(6)] + [(9, "2024-01-01 00:00:05", 2, "t", 400.0, "{}")]
    frame = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "to_timestamp_ntz(ts) AS ts", "user_id", "event_type", "value", "props")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = budget.admissions(budget.request_log(spark, str(tmp_path / "in")), limit=100)
    try:
        got = {r.event_id: r.admitted for r in budget.run_once(stream, str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 9: False}
