"""Every registered query against its SQL, over the smallest tables."""

import pytest

from planestack.plans import registry
from tests.compare import assert_same, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, connection, name):
    assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], connection)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
