import __spark_entry__ as entry

from .conftest import DATA


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_event_queries_run(spark):
    for name, query in entry.queries().items():
        if not name.startswith("op") and name != "pipeline":
            assert query(spark, DATA).columns
