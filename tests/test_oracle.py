"""Every query with SQL against DuckDB on the smallest tables, at full precision."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from evigraph.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].map(lambda v: "∅" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v)).astype(object)
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    mine, theirs = plain(QUERIES[name](spark, SF).toPandas()), plain(duck.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(mine, theirs, check_exact=True, check_dtype=False)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
