"""Every query runs on the smallest tables, and equals its SQL twin."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
NAMES = [n for n in driver.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    got = df.collect()
    if name not in driver.oracle_sql():
        assert got
        return
    found = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    place = [columns.index(c) for c in df.columns]
    want = [tuple(row[k] for k in place) for row in found.fetchall()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_entry(spark):
    assert driver.entry(spark).count() > 0
