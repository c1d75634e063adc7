"""Every query with SQL against that SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from scrivano.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if not isinstance(v, (int, str)) and hasattr(v, "as_integer_ratio"):
        return float(v)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in told.fetchall()]
    assert ordered([tuple(r[c] for c in columns) for r in df.collect()]) == ordered(rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
