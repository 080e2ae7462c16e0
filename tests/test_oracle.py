"""Every registered query against its SQL twin on the smallest data."""

import os

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQLS = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQLS:
        assert compare(df, con, SQLS[name]) == []
    else:
        assert df.count() > 0
