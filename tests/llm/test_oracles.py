"""The registered SQL of the operators gives the rows of their queries."""

import glob
import os

import duckdb
import pytest

from scrivano.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    told = con.execute(queries.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(map(str, told.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == rows
