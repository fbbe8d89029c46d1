import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from readloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = tables.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(names) == columns
    assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
