"""Queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from geoloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    wanted = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, data).toPandas()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns and len(got) == len(wanted)
    got, wanted = (x[columns].sort_values(columns, ignore_index=True) for x in (got, wanted))
    assert all(((got[c] == wanted[c]) | (got[c].isna() & wanted[c].isna())).all() for c in columns)
