"""Every registered query against its SQL, on whole tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _rows(frame):
    """Rows as texts; a column of integers with nulls is one of floats or of integers, as its engine hands it over."""
    columns = sorted(frame.columns)
    texts = []
    for name in columns:
        column = frame[name].astype(object)
        if frame[name].isna().any():
            column = [None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x for x in column]
        texts.append(list(map(str, column)))
    return columns, sorted(zip(*texts))


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, duck, name):
    found = entry_module.queries()[name](spark, SF).toPandas()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert len(found)
    else:
        assert _rows(found) == _rows(duck.sql(sql).df())


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
