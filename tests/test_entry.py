"""Every query runs on the smallest tables and, where there is SQL for it, equals DuckDB's answer."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: v for k, v in entry.queries().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list:
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    show = lambda v: None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else repr(round(float(v), 6)) if number(v) else str(v)
    return sorted((tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, db, name):
    found = OWN[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = db.sql(sql).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "common", "score"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
