"""Every query of the library gives the rows of its SQL."""

import pytest
from tests.sqlcheck import connect, differences

from evidence.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    spark_only, sql_only = differences(QUERIES[name](spark, data), duck, SQL[name])
    assert not spark_only and not sql_only, (list(spark_only)[:2], list(sql_only)[:2])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
