"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__
from scholia import plans
from scholia.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    rows = plans.QUERIES[name](spark, DATA).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(rows)
        return
    db = duckdb.connect()
    for table in os.listdir(DATA):
        db.sql(f"create view {table.removesuffix('.parquet')} as select * from '{DATA}/{table}'")
    other = db.sql(plans.ORACLE_SQL[name]).df()
    columns = sorted(rows.columns)
    assert columns == sorted(other.columns)
    plain = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert plain(rows) == plain(other)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_tasks_do_not_grow_with_a_table(spark, monkeypatch):
    size = os.path.getsize(f"{DATA}/documents.parquet")
    monkeypatch.setattr(queries, "TASK", size // 9, raising=False)
    table = queries._read(spark, DATA, "documents")
    assert table.rdd.getNumPartitions() >= 9
    assert table.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_entry_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
