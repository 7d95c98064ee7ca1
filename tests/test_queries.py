"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as registered
from agreement import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    result = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(result, db, ORACLES[name]) is None
    else:
        assert result.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() == 150
