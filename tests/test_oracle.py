"""Every registered query against its DuckDB oracle on sf0.001 (the driver
checks sf0.01 the same way)."""

import os

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con, verbose=True)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "n_pages" in df.columns
