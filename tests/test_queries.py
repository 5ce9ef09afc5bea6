"""Every query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from docframe.plans.queries import QUERIES, ROUTES_SQL, SQL, routes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert rows
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=str) == rows


def test_routes(spark, duck):
    want = duck.sql(ROUTES_SQL)
    assert sorted(map(tuple, routes(spark).select(*want.columns).collect())) == sorted(want.fetchall())
