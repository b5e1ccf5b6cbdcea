import os

import duckdb
import pytest

from tidemark.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    mine = registry.queries()[name](spark, DATA)
    base = duckdb.connect()
    for file in os.listdir(DATA):
        base.execute(f"CREATE VIEW {file.partition('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    columns = sorted(mine.columns)
    theirs = base.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in mine.select(columns).collect())
