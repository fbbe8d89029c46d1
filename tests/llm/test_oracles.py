"""The registered SQL on DuckDB against the queries."""

import glob
import os

import duckdb
import pytest

from readloom.llm.oracles import ORACLES
from readloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == want
