"""The contract: an entry query, and SQL only for queries that exist."""

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "user_id"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
