"""The driver's contract."""

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.dtypes == [("tax_id", "string"), ("period", "bigint"), ("education", "string"), ("wage", "double")] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
