import pytest

from tessera.plans import registry
from tests.compare import compare, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
    else:
        assert compare(spark, registry.queries()[name], sql, con) == ""
