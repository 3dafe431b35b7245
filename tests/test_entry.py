import __spark_entry__ as entry
from tessera import plans


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["vid", "t", "h", "w", "c", "v"] and df.count() == 500 * 8


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())
