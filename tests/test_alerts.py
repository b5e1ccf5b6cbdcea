"""The stateful processor against a batch over the same events, over restarts and with late rows."""

import datetime
import random

import pytest

from tidemark.streaming.alerts import alerts

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def arrive(spark, folder, rows):
    data = [(i, None if m is None else at(m), u, k, v) for i, m, u, k, v in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder):
    stream = alerts(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), hours=1, forget_days=1)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def batch(rows):
    """event_id -> user, n_events, sum_value, first_seen, from all events at once."""
    out = {}
    for i, m, u, kind, _ in rows:
        near = [r for r in rows if r[2] == u and m - 60 <= r[1] <= m]
        seen = [r for r in rows if r[2] == u and r[3] == kind and (r[1], r[0]) < (m, i)]
        out[i] = (u, len(near), round(sum(r[4] or 0.0 for r in near), 6), not seen or m - max(r[1] for r in seen) > 24 * 60)
    return out


def test_equals_batch_over_restarts_with_late_rows(rocks, tmp_path):
    """Four runs from one checkpoint; each part comes in disorder within the allowed hour, and late rows are dropped."""
    rng = random.Random(2)
    events = [(k, 7 * k + rng.randrange(40), rng.choice([1, 2, None]), rng.choice(["view", "signup", None]), rng.choice([None, 1.5, 2.25])) for k in range(200)]
    events += [(500, 400, 1, "view", 1.0), (501, 400, 1, "view", 2.0), (502, 3500, 1, "view", 1.0), (503, 3600, 2, "signup", 1.0)]
    parts = [[e for e in events if lo <= e[1] < hi] for lo, hi in ((-1, 500), (500, 1000), (1000, 9000))]
    late = [(900, 5, 1, "view", 99.0), (901, 300, 2, "purchase", 99.0)]
    for k, part in enumerate(parts):
        rng.shuffle(part)
        arrive(rocks, tmp_path, part + (late if k == 2 else []) + [(910 + k, None, 1, "view", 1.0)])
        run(rocks, tmp_path)
        if k == 1:
            arrive(rocks, tmp_path, late)
            run(rocks, tmp_path)
    arrive(rocks, tmp_path, [(999, 20_000, 3, "view", 1.0)])
    got = run(rocks, tmp_path)
    mine = {r.event_id: (r.user_id, r.n_events, round(r.sum_value, 6), r.first_seen) for r in got}
    assert len(got) == len(mine)
    assert {k: v for k, v in mine.items() if k in (900, 901)} == {}
    assert mine == batch(events)
