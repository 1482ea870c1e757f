"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from tests.oracle import connect, difference

import __spark_entry__ as entry
from lodestrata.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert difference(df, con, SQL[name]) == ""
    else:
        assert df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
