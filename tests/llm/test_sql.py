"""Queries of the llm operators with SQL give what DuckDB gives."""

import os

import duckdb
import pytest

from scholia.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    rows = queries.QUERIES[name](spark, DATA).toPandas()
    db = duckdb.connect()
    for table in os.listdir(DATA):
        db.sql(f"create view {table.removesuffix('.parquet')} as select * from '{DATA}/{table}'")
    other = db.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(rows.columns)
    assert columns == sorted(other.columns)
    plain = lambda df: sorted(map(tuple, df[columns].values.tolist()), key=str)
    assert plain(rows) == plain(other)
