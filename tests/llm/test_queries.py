import pytest

from quiverlane.llm import plans
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_as_sql(spark, data, con, name):
    assert_same(plans.QUERIES[name](spark, data), con, plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() >= 0
