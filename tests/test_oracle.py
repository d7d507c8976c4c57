"""Every query with a SQL equivalent gives the same rows as DuckDB; the others return rows."""

import pytest
from compare import connect, difference
from conftest import SMALL

from seqloom.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


SLOW = {"dataset_build"}  # has its own test


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
