"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from galley.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else (float(v) if isinstance(v, Number) and not isinstance(v, bool) else str(v))
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["recipe_facet_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderstatus" in plan and "o_totalprice" not in plan
