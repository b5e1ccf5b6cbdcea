"""Change points and the isolation forest against plain versions (plain sums in order, as sum() compensates for rounding)."""

import datetime
import math
import random
from functools import reduce
from operator import add

import pytest

from tidemark.operators import changes, isolation

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, kind string, hour string, run string"
ORIGIN = datetime.datetime(2024, 1, 1)


def events(spark, hours):
    """One event for each (kind, hour), a null hour being an event without ts."""
    rows = [(k, None if h is None else ORIGIN + datetime.timedelta(hours=h, minutes=k % 60), 1, kind, 1.0, "x", "x", "x") for k, (kind, h) in enumerate(hours)]
    return spark.createDataFrame(rows, EVENT)


def plain_changes(hours, allowance=0.5, limit=5.0):
    out = []
    for kind in {k for k, h in hours if h is not None}:
        at = [h for k, h in hours if k == kind and h is not None]
        counts = [at.count(h) for h in range(min(at), max(at) + 1)]
        n, total = len(counts), sum(counts)
        deviation = math.sqrt(max(0, n * sum(c * c for c in counts) - total * total))
        most = math.floor(1000 * limit * deviation / n)
        for direction, sign in (("up", 1), ("down", -1)):
            rest = sign * math.floor(1000 * total / n + sign * 1000 * allowance * deviation / n)
            held, began, alarm, peak = 0, None, None, 0
            for k, c in enumerate([*counts, None]):
                after = 0 if c is None else max(0, held + sign * 1000 * c - rest)
                if not after and held and alarm is not None:
                    out.append((kind, direction, *(ORIGIN + datetime.timedelta(hours=min(at) + h) for h in (began, alarm, k - 1)), peak))
                if not after:
                    began, alarm, peak = None, None, 0
                else:
                    began = k if began is None else began
                    alarm = k if alarm is None and after > most else alarm
                    peak = max(peak, after)
                held = after
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("event_type", "direction", "begins", "alarm", "ends", "peak_milli").collect()), key=str)


@pytest.mark.parametrize("allowance, limit", [(0.5, 5.0), (0.25, 2.0), (0.0, 1.0)])
def test_changes_equal_the_sequential_sums(spark, allowance, limit):
    """Kinds with empty hours, the null kind, one hour only, equal counts in all hours, and events without ts."""
    rng = random.Random(1)
    hours = [(kind, rng.randrange(lo, hi)) for kind, lo, hi, n in (("a", 0, 300, 400), ("b", 50, 90, 500), (None, 10, 400, 200)) for _ in range(n)]
    hours += [("a", rng.randrange(120, 130)) for _ in range(80)] + [("once", 5)] * 9 + [("flat", h) for h in range(30)] + [("a", None), ("never", None)]
    got = found(changes.change_points(events(spark, hours), allowance, limit))
    assert got == plain_changes(hours, allowance, limit) and got
    assert not {"once", "flat", "never"} & {r[0] for r in got}


def test_planted_changes_are_found(spark):
    """Three times as many events from hour 200, and none from 300 to 339."""
    rng = random.Random(2)
    rate = lambda h: 0 if 300 <= h < 340 else 30 if 200 <= h < 220 else 10
    hours = [("view", h) for h in range(500) for _ in range(max(0, rate(h) + rng.randrange(-2, 3)) if rate(h) else 0)]
    rows = found(changes.change_points(events(spark, hours)))
    assert [r[1] for r in rows] == ["down", "up"]
    begins = {r[1]: (r[2] - ORIGIN) / datetime.timedelta(hours=1) for r in rows}
    assert begins == {"down": 300, "up": 200}
    alarm = {r[1]: (r[3] - ORIGIN) / datetime.timedelta(hours=1) for r in rows}
    assert alarm["up"] <= 203 and alarm["down"] <= 305


ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string, price string, days string, n_lines long"
LINE = "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz, l_linenumber int, score string"


def order(key, price, when=ORIGIN):
    return (key, 1, "O", price, when, "1-URGENT", "x", "x", 0)


def line(key, quantity=1.0, price=10.0, discount=0.1, days=3):
    return (key, quantity, price, discount, None if days is None else ORIGIN + datetime.timedelta(days=days), 1, "x")


def path(tree, row):
    while not isinstance(tree, float):
        k, split, below, other = tree
        tree = below if row[k] < split else other
    return tree


def test_forest_in_sql_equals_the_trees(spark):
    rng = random.Random(3)
    orders = [order(k, rng.random() * 1000) for k in range(300)]
    orders += [order(7, 5.0), order(7, 5.0), order(None, 3.0), order(900, None, None), order(901, math.nan), order(902, math.inf), order(903, -math.inf), order(904, 1e300)]
    lines = [line(rng.randrange(310), float(rng.randrange(50)), rng.random() * 100, rng.randrange(10) / 100, rng.choice([1, 5, None])) for _ in range(900)]
    lines += [line(None), line(5, None, None, None, None), line(6, math.nan), line(8, 1e300)]
    o, li = spark.createDataFrame(orders, ORDER), spark.createDataFrame(lines, LINE)
    features = isolation.order_features(o, li)
    plain = {}
    for key, *values in map(tuple, features.select("o_orderkey", *isolation.FEATURES).collect()):
        plain.setdefault(key, []).append(tuple(values))
    by_hand = [x for x in lines if x[0] == 17]
    assert plain[17][0][1:5] == (len(by_hand), sum(x[1] for x in by_hand), max((x[3] for x in by_hand), default=0.0), max((x[2] for x in by_hand), default=0.0))
    assert len(plain[7]) == 3 and plain[None] == [(3.0, 0.0, 0.0, 0.0, 0.0, 0.0)] and plain[900] == [(0.0,) * 6]
    rows = isolation.sampled(features, 200)
    assert len(rows) == 200 and repr(rows) == repr(isolation.sampled(isolation.order_features(o.repartition(7), li.repartition(5)), 200))
    forest = isolation.fit(rows, 20, 64, 5)
    got = isolation.isolation_scores(o, li, 200, 20, 64, 5).collect()
    expected = sorted((str(key), reduce(add, (path(t, v) for t in forest)) / 20) for key, all_ in plain.items() for v in all_)
    assert sorted((str(r.o_orderkey), r.path_length) for r in got) == expected
    for r in got:
        assert r.score == pytest.approx(2 ** (-r.path_length / isolation.expected_path(64)), rel=1e-12)


def test_an_order_unlike_all_others_stands_out(spark):
    rng = random.Random(4)
    orders = [order(k, 100 + rng.random()) for k in range(500)] + [order(1000, 10_000.0)]
    lines = [line(k, float(rng.randrange(1, 5))) for k in range(500)] + [line(1000, 500.0, 9000.0, 0.9, 300)]
    got = isolation.isolation_scores(spark.createDataFrame(orders, ORDER), spark.createDataFrame(lines, LINE)).collect()
    best = max(got, key=lambda r: r.score)
    assert best.o_orderkey == 1000 and best.score > max(r.score for r in got if r.o_orderkey != 1000) + 0.1


def test_nothing_and_all_alike(spark):
    none_o, none_l = spark.createDataFrame([], ORDER), spark.createDataFrame([], LINE)
    assert isolation.isolation_scores(none_o, none_l).count() == 0
    assert isolation.isolation_scores(none_o, none_l).columns == ["o_orderkey", "path_length", "score"]
    one = isolation.isolation_scores(spark.createDataFrame([order(1, 2.0)], ORDER), none_l).collect()
    assert [(r.o_orderkey, r.score) for r in one] == [(1, 0.5)]
    alike = isolation.isolation_scores(spark.createDataFrame([order(k, 2.0) for k in range(50)], ORDER), none_l).collect()
    assert all(r.score == pytest.approx(0.5) for r in alike)
    assert changes.change_points(events(spark, [])).count() == 0
