"""Registered queries against DuckDB where SQL can express them, on the smallest tables."""

import os

import duckdb
import pytest

from riskspark.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    expected = cur.fetchall()
    columns = [d[0] for d in cur.description]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(df.columns) == sorted(columns) and len(got) == len(expected) > 0
    assert sorted(got, key=str) == sorted(expected, key=str)
