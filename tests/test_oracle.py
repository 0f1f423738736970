import pytest

from quiverlane.plans import registry
from tests.oracle import assert_same, connection

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
