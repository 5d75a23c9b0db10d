"""Every registered query of the reference operators against its DuckDB counterpart on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    cell = lambda x: "" if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
