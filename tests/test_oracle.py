"""Every registered query that has SQL gives the same rows as DuckDB; the rest run."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from quern import queries as core


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def normal(df):
    def cell(v):
        if pd.isna(v):
            return None
        return repr(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(df.columns), Counter(tuple(map(cell, r)) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf, con, name):
    got = core.queries()[name](spark, sf).toPandas()
    if name in core.oracle_sql():
        assert normal(got) == normal(con.sql(core.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "version", "event_type", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())
