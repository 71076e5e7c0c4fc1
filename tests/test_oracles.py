"""Each query against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
WAREHOUSE = sorted(entry.warehouse.ORACLES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", WAREHOUSE)
def test_oracle(spark, duck, name):
    df, sql = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(sql.columns, sql.fetchall())


def test_every_query_has_an_oracle():
    assert set(entry.warehouse.QUERIES) == set(entry.warehouse.ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
