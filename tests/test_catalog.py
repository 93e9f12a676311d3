"""Every plan against its oracle on another engine, and that it is not vacuous."""

import glob
import os

import duckdb
import pytest

from docstrata.plans.catalog import ORACLE_SQL, PLANS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan_matches_oracle(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER)
    want = oracle.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple(repr(row[c]) for c in columns)
    mine = sorted(key(r) for r in got.collect())
    assert mine, "a query without rows shows nothing"
    assert mine == sorted(key(dict(zip(want.columns, r, strict=True))) for r in want.fetchall())
