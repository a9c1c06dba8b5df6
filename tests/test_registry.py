"""Every query of the core beside its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from pagewright.queries import QUERIES
from pagewright.queries_sql import SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)) or getattr(x, "ndim", 0):
        return [plain(y) for y in x]
    if x is None or pd.isna(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float) and abs(x) < 1e18:
        return int(x) if x == int(x) else round(x, 6)
    return x


def rows(frame, columns):
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name not in SQL:
        return
    want = db.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
