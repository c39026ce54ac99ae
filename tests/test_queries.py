"""Every query against its SQL counterpart, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == ""
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
