"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillmark import plans


#: Queries that find nothing in the smallest tables; they do at the next size.
SMALL: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x) -> str:
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if x is None or pd.isna(x):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return str(int(x)) if float(x).is_integer() else repr(float(x))
    return str(x)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    ours, theirs = plans.queries()[name](spark, sf_dir).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    assert len(ours) or name in SMALL, "both sides are empty"


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0
