"""The driver contract: names agree and each SQL twin belongs to a query."""

import __spark_entry__ as entry


def test_names():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 240


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
