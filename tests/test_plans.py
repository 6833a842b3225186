"""Every plan against the oracle, run by DuckDB over the same files: row count, columns, values."""

import duckdb
import pandas as pd
import pytest

from quirebase import queries
from quirebase.session import TABLES


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    blank = lambda v: "none" if v is None or v is pd.NA or v is pd.NaT or v != v else str(v)
    return sorted(tuple(map(blank, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_plan(spark, sf, oracle, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), oracle.sql(queries.ORACLES[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_exploded_numbers_are_not_broadcast(spark, sf):
    """The numbers of citations are many times the rows of the table that the estimate goes by."""
    plan = queries.QUERIES["j07_goto_citations"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
