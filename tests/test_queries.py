"""Every query of the log against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from foldlake.plans import catalog, catalog_store  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    names = sorted(df.columns)
    clean = lambda v: None if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, (int, float)) else v
    return sorted((tuple(clean(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), sql.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert str(rows(got)) == str(rows(want))
