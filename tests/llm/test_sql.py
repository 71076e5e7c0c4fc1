"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from millrace.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, sql = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(tuple(r[i] for i in at) for r in sql.fetchall())


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
