"""Every registered query against its SQL on the smallest tables, and what has none against fixtures."""

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from aerolith.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    return str(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v)


def canonical(frame):
    return sorted(tuple(map(text, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
