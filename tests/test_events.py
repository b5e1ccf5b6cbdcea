import datetime

import duckdb
import pytest

from tidemark.operators import events as ops
from tidemark.plans import risk
from tidemark.streaming import events as streams

from .conftest import DATA


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_the_random_forest_and_sketches_have_no_sql():
    assert set(risk.queries()) - set(risk.oracle_sql()) == {"order_isolation", "trailing_week"}


@pytest.mark.parametrize("name", sorted(risk.oracle_sql()))
def test_equals_sql(spark, name):
    mine = risk.queries()[name](spark, DATA)
    base = duckdb.connect()
    for name_of in ("events", "orders", "lineitem"):
        base.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{DATA}/{name_of}.parquet'")
    columns = ", ".join(mine.columns)
    theirs = base.execute(f"SELECT {columns} FROM ({risk.oracle_sql()[name]})").fetchall()
    assert rows(mine) == sorted(map(tuple, theirs), key=str)


@pytest.fixture(scope="module")
def few(spark):
    """Ties in time, null users and values, and a gap of exactly 30 minutes."""
    at = lambda m: datetime.datetime(2024, 1, 1, 10, 0) + datetime.timedelta(minutes=m)
    data = [(1, at(0), 1, "signup", 1.0), (2, at(0), 1, "view", None), (3, at(30), 1, "purchase", 3.0), (4, at(60), 1, "view", 4.0), (5, at(61), None, "view", 5.0), (6, at(421), 1, "purchase", 9.0)]
    return spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_trailing_hour_includes_its_edge_and_ties(few):
    assert {r.event_id: r.n_events for r in ops.velocity(few).collect()} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 1, 6: 1}


def test_sessions_end_after_the_gap(few):
    assert sorted(r.n_events for r in ops.user_sessions(few).where("user_id = 1").collect()) == [1, 4]


def test_sequences_respect_the_limit(few):
    assert rows(ops.sequence_match(few)) == [(1, 1, 3)]
    assert rows(ops.sequence_match(few, hours=8)) == [(1, 1, 3), (1, 1, 6)]


def test_empty_table(spark, few):
    none = few.where("false")
    for operator in (ops.velocity, ops.gap_since_previous, ops.distinct_types, ops.value_zscore, ops.value_percentile, ops.hourly_profile, ops.user_sessions, ops.sequence_match, ops.last_before, ops.risk_score):
        assert operator(none).count() == 0


def streamed(spark, df, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def source(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), events


def test_stream_of_counts_equals_batch(spark, tmp_path):
    stream, events = source(spark, tmp_path)
    out = streamed(spark, streams.tumbling_counts(stream), "complete", "counts")
    assert rows(out) == rows(streams.tumbling_counts(events))


def test_stream_of_sequences_equals_batch(spark, tmp_path):
    stream, events = source(spark, tmp_path)
    out = streamed(spark, streams.sequence_match(stream), "append", "sequences")
    assert rows(out) == rows(ops.sequence_match(events))


def batch_of(spark, folder, name, rows):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, 0) + datetime.timedelta(minutes=m)
    data = [(i, at(m), u, kind, float(i)) for i, m, u, kind in rows]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in"


def run_stream(spark, operator, folder, into):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    out = operator(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{into}").option("checkpointLocation", f"{folder}/{into}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/{into}")


def test_counts_drop_late_rows_and_go_on_after_a_restart(spark, tmp_path):
    """Three runs of one query from its checkpoint; a row later than the watermark is not counted."""
    batch_of(spark, tmp_path, "one", [(1, 0, 1, "view"), (2, 30, 1, "view")])
    run_stream(spark, streams.tumbling_counts, tmp_path, "counts")
    batch_of(spark, tmp_path, "two", [(3, 50, 1, "view"), (4, 600, 2, "view")])
    run_stream(spark, streams.tumbling_counts, tmp_path, "counts")
    batch_of(spark, tmp_path, "three", [(5, 10, 1, "view"), (6, 1200, 2, "view")])
    got = {(r.user_id, r.start.hour): r.n_events for r in run_stream(spark, streams.tumbling_counts, tmp_path, "counts").collect()}
    assert got == {(1, 10): 3, (2, 20): 1}


def test_sequences_match_across_restarts_and_not_late_rows(spark, tmp_path):
    batch_of(spark, tmp_path, "one", [(1, 0, 1, "signup"), (2, 5, 1, "purchase")])
    run_stream(spark, streams.sequence_match, tmp_path, "pairs")
    batch_of(spark, tmp_path, "two", [(3, 200, 1, "purchase"), (4, 1500, 2, "signup"), (5, 1501, 2, "purchase")])
    run_stream(spark, streams.sequence_match, tmp_path, "pairs")
    batch_of(spark, tmp_path, "three", [(6, 20, 1, "purchase"), (7, 3000, 3, "signup"), (8, 3001, 3, "purchase")])
    got = rows(run_stream(spark, streams.sequence_match, tmp_path, "pairs"))
    assert got == sorted([(1, 1, 2), (1, 1, 3), (2, 4, 5), (3, 7, 8)], key=str)
