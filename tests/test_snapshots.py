"""Changes between snapshots against multisets in Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import snapshots

ROW = "k long, j string, v double, __part string, n long"


def frame(spark, rows):
    return spark.createDataFrame(list(rows), ROW)


def row(k, j="a", v=1.0):
    return (k, j, v, "x", 0)


def counted(df):
    return Counter(repr(tuple(r)) for r in df.collect())


def plain(before, after, key):
    net = Counter(map(repr, after))
    net.subtract(Counter(map(repr, before)))
    key_of = {repr(r): key(r) for r in [*before, *after]}
    gains = {}
    for r, n in net.items():
        if n:
            gains.setdefault(key_of[r], set()).add(n > 0)
    kinds = {k: "changed" if len(s) > 1 else "inserted" if True in s else "deleted" for k, s in gains.items()}
    return {(r, kinds[key_of[r]], n) for r, n in net.items() if n}


@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_difference_and_its_application(spark, keys):
    """Null keys and values, repeats in one or both snapshots, unchanged rows, and another order of columns."""
    rng = random.Random(1)
    some = lambda: [row(rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, None, float("inf")])) for _ in range(200)]
    same = [row(100 + k) for k in range(20)] * 2
    before, after = some() + same + [row(500)] * 3 + [row(501)] * 2 + [row(502)], some() + same + [row(500)] * 5 + [row(501)] + [row(503)]
    b, a = frame(spark, before), frame(spark, after)
    changes = snapshots.difference(b, a.select("n", "v", "k", "j", "__part"), keys)
    got = {(repr(tuple(r)[:5]), r.change, r.copies) for r in changes.collect()}
    at = lambda r: r[: len(keys)]
    assert got == plain(before, after, at)
    assert {(repr(row(500)), "inserted", 2), (repr(row(501)), "deleted", -1), (repr(row(502)), "deleted", -1), (repr(row(503)), "inserted", 1)} <= got
    assert counted(snapshots.applied(b, changes)) == counted(a)
    assert counted(snapshots.applied(a, changes.withColumn("copies", -F.col("copies")))) == counted(b)


def test_many_copies_of_one_row(spark):
    """More copies than one array holds, on both sides of its size."""
    copies = lambda n: spark.range(n).select(F.lit(1).cast("long").alias("k"), F.lit("a").alias("j"))
    for n in (snapshots.COPIES - 1, snapshots.COPIES, 3 * snapshots.COPIES + 1):
        changes = snapshots.difference(copies(5), copies(n), ["k"])
        assert [tuple(r) for r in changes.collect()] == [(1, "a", "inserted", n - 5)]
        assert snapshots.applied(copies(5), changes).count() == n


def test_equal_floats_are_no_change(spark):
    nan = frame(spark, [row(1, "a", float("nan")), row(2, "a", 0.0), row(3, None, None)])
    other = frame(spark, [row(1, "a", float("nan")), row(2, "a", -0.0), row(3, None, None)])
    assert snapshots.difference(nan, other, ["k"]).count() == 0


def test_nothing_and_names(spark):
    none, some = frame(spark, []), frame(spark, [row(1), row(1), row(None)])
    assert snapshots.difference(none, none, ["k"]).count() == 0
    assert {(r.k, r.change, r.copies) for r in snapshots.difference(none, some, ["k"]).collect()} == {(1, "inserted", 2), (None, "inserted", 1)}
    assert {(r.k, r.change, r.copies) for r in snapshots.difference(some, none, ["k"]).collect()} == {(1, "deleted", -2), (None, "deleted", -1)}
    with pytest.raises(ValueError):
        snapshots.difference(some, some.drop("v"), ["k"])
    named = some.withColumnRenamed("j", "change")
    with pytest.raises(ValueError):
        snapshots.difference(named, named, ["k"])
    assert snapshots.difference(named, named.limit(0), ["k"], "kind_of_change", "copies").count() == 2


def test_order_lines_meet_in_tasks_that_follow_the_tables(spark, monkeypatch):
    """Orders of either day, both or none, null dates and keys, repeated lines; no task gets a share that grows with the tables."""
    import datetime

    rng, day = random.Random(9), datetime.datetime(1997, 1, 1)
    dates = [None, *(day + datetime.timedelta(days=d) for d in (-366, -365, -364, -184, -183, 0, 1, 181, 182))]
    orders = [(k, rng.randrange(9), rng.choice(dates)) for k in range(400)] + [(None, 1, day)]
    lines = [(rng.choice([None, *range(420)]), rng.choice(["A", "N", None]), rng.choice(dates)) for _ in range(3000)]
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    li = spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_shipdate timestamp_ntz")
    days = day, day + datetime.timedelta(days=181)
    monkeypatch.setattr(snapshots, "TASK_ROWS", 100)

    def at(d):
        recent = {k: c for k, c, placed in orders if k is not None and placed and d - datetime.timedelta(days=365) < placed <= d}
        return [(k, recent[k], flag, "shipped" if shipped and shipped <= d else "waiting") for k, flag, shipped in lines if k in recent]

    got = {(repr(tuple(r)[:4]), r.change, r.copies) for r in snapshots.order_line_changes(o, li, *days).collect()}
    assert got == plain(at(days[0]), at(days[1]), lambda r: r[0]) and {kind for _, kind, _ in got} == {"changed", "inserted", "deleted"}
    sizes = [r["count"] for r in snapshots.signed_lines(o, li, *days).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 30 and max(sizes) < sum(sizes) / 8
