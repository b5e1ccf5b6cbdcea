"""Peeling against a plain version, its bound by all blocks of a small graph; sketches against exact answers."""

import datetime
import itertools
import math
import random

import pytest

from tidemark.operators import dense, sketches

from .conftest import DATA

PAIR = "left long, right long, weight long"


def plain_peeling(pairs, slack=10):
    """{(side, member): last round}, densities; pairs (left, right, weight)."""
    rest, last, densities, aim = list(pairs), {}, [], None
    while rest:
        weight = {}
        for l, r, w in rest:
            weight["left", l] = weight.get(("left", l), 0) + w
            weight["right", r] = weight.get(("right", r), 0) + w
        n = {side: sum(s == side for s, _ in weight) for side in ("left", "right")}
        total = sum(w for _, _, w in rest)
        aim = aim or n
        densities.append(total / math.sqrt(n["left"] * n["right"]))
        last |= dict.fromkeys(weight, len(densities))
        side = "left" if n["left"] * aim["right"] >= aim["left"] * n["right"] else "right"
        leaves = {m for (s, m), w in weight.items() if s == side and 100 * w * n[side] <= (100 + slack) * total}
        rest = [p for p in rest if p[0 if side == "left" else 1] not in leaves]
    return last, densities


def random_pairs(seed, lefts, rights, n, block=((), ())):
    rng = random.Random(seed)
    pairs = {(rng.randrange(lefts), rng.randrange(rights)): rng.randrange(1, 4) for _ in range(n)}
    for l, r in itertools.product(*block):
        pairs[l, r] = 5
    return [(l, r, w) for (l, r), w in sorted(pairs.items())]


@pytest.mark.parametrize("slack", [0, 10, 50])
def test_peeling_equals_the_plain_version(spark, slack):
    pairs = random_pairs(slack, 60, 25, 300)
    got, densities = dense.peeled(spark.createDataFrame(pairs, PAIR).repartition(3), slack)
    want, all_densities = plain_peeling(pairs, slack)
    rows = got.collect()
    assert densities == all_densities and sorted((r.left, r.right, r.weight) for r in rows) == pairs
    last = {}
    for r in rows:
        for member in (("left", r.left), ("right", r.right)):
            last[member] = max(last.get(member, 0), r.round)
    assert last == want


def test_block_of_the_table_equals_the_plain_version(spark):
    orders, lines = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("orders", "lineitem"))
    pairs = [tuple(r) for r in dense.trade(orders, lines).collect()]
    last, densities = plain_peeling(pairs)
    first = densities.index(max(densities)) + 1
    side = {"left": "customer", "right": "supplier"}
    want = {(side[s], m): (k, k >= first, max(densities)) for (s, m), k in last.items()}
    assert {(r.side, r.member): (r.rounds, r.in_block, r.density) for r in dense.dense_block(orders, lines).collect()} == want


def test_density_is_within_the_bound_of_all_blocks_of_that_proportion(spark):
    for seed in range(3):
        pairs = random_pairs(seed, 8, 4, 18)
        lefts, rights = {l for l, _, _ in pairs}, {r for _, r, _ in pairs}
        best = 0.0
        for a in range(1, len(lefts) + 1):
            for b in range(1, len(rights) + 1):
                if a * len(rights) != len(lefts) * b:
                    continue
                for s, t in itertools.product(itertools.combinations(sorted(lefts), a), itertools.combinations(sorted(rights), b)):
                    best = max(best, sum(w for l, r, w in pairs if l in s and r in t) / math.sqrt(a * b))
        _, densities = dense.peeled(spark.createDataFrame(pairs, PAIR), 10)
        assert max(densities) >= best / 2.2


def tables(spark, pairs):
    """Orders and lines of pairs, one order for each pair, with columns of clashing names."""
    orders = [(k, l, "x", "x") for k, (l, _, _) in enumerate(pairs)]
    lines = [(k, r, "x", "x") for k, (_, r, w) in enumerate(pairs) for _ in range(w)]
    return spark.createDataFrame(orders, "o_orderkey long, o_custkey long, weight string, side string"), spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, round string, member string")


def test_planted_block_is_found_and_odd_rows_are_left_out(spark):
    """A hot supplier sells to a third of all pairs; a block of 20 customers and 10 suppliers is dense."""
    pairs = random_pairs(5, 400, 200, 600, (range(20), range(10)))
    pairs += [(c, 999, 1) for c in range(400)] + [(None, 3, 2), (4, None, 2), (None, None, 1)]
    orders, lines = tables(spark, pairs)
    lines = lines.unionByName(spark.createDataFrame([(10**6, 1, "x", "x"), (None, 1, "x", "x")], lines.schema))
    rows = dense.dense_block(orders, lines).collect()
    inside = {(r.side, r.member) for r in rows if r.in_block}
    planted = {("customer", c) for c in range(20)} | {("supplier", s) for s in range(10)}
    assert planted <= inside and len(inside - planted) <= 3
    assert not [r for r in rows if r.member is None]


def test_empty_tables_have_no_block(spark):
    orders, lines = tables(spark, [(1, 2, 1)])
    for o, l in ((orders.where("false"), lines), (orders, lines.where("false"))):
        assert dense.dense_block(o, l).columns == ["side", "member", "rounds", "in_block", "density"]
        assert dense.dense_block(o, l).count() == 0


EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, kind string, hour string, users string"
ORIGIN = datetime.datetime(2024, 1, 1)


def events(spark, rows):
    """Events of (kind, minutes after the start or None, user, value)."""
    at = lambda m: None if m is None else ORIGIN + datetime.timedelta(minutes=m)
    return spark.createDataFrame([(k, at(m), u, kind, v, "x", "x", "x") for k, (kind, m, u, v) in enumerate(rows)], EVENT)


def many(n, users, days, seed=1):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randrange(days * 1440), rng.randrange(users), rng.lognormvariate(0, 2)) for _ in range(n)]


def near(values, got, at, error=0.03):
    """Whether got's rank among the values is within the error of the asked one."""
    values = sorted(values)
    low, high = sum(v < got for v in values) / len(values), sum(v <= got for v in values) / len(values)
    return low - error <= at <= high + error


def test_trailing_week_is_within_the_stated_errors(spark):
    rows = many(40_000, 6_000, 20)
    found = {(r.event_type, (r.day - ORIGIN.date()).days): r for r in sketches.trailing_week(events(spark, rows)).collect()}
    assert set(found) == {(kind, day) for kind in "ab" for day in range(20)}
    for (kind, day), r in found.items():
        part = [x for x in rows if x[0] == kind and day - 6 <= x[1] // 1440 <= day]
        users = len({x[2] for x in part})
        assert r.n_events == len(part)
        assert abs(r.n_users - users) <= 4 * 1.04 / 64 * users
        assert near([x[3] for x in part], r.p50, 0.5) and near([x[3] for x in part], r.p95, 0.95)


def test_late_events_are_added_without_reading_the_early_ones_again(spark, tmp_path):
    """States of three loads lie in one table; ranges that begin and end anywhere are merged from it."""
    rows = many(6_000, 150, 6, seed=2)
    for part in range(3):
        sketches.hourly_states(events(spark, rows[part::3])).write.mode("append").parquet(f"{tmp_path}/states")
    states = spark.read.parquet(f"{tmp_path}/states")
    start = 24 * (ORIGIN - datetime.datetime(1970, 1, 1)).days
    for first, last in ((0, 143), (7, 31), (100, 100)):
        got = {r.kind: r for r in sketches.answers(sketches.between(states, start + first, start + last), {"p50": 0.5}).collect()}
        for kind in "ab":
            part = [x for x in rows if x[0] == kind and first <= x[1] // 60 <= last]
            assert (got[kind].n_events, got[kind].n_users) == (len(part), len({x[2] for x in part}))
            assert near([x[3] for x in part], got[kind].p50, 0.5)
    hourly = sketches.merged(states, "kind", "hour")
    assert hourly.count() == states.select("kind", "hour").distinct().count()


def test_odd_events_in_sketches(spark):
    rows = [(None, 0, 1, 2.0), (None, 0, 1, 2.0), ("nulls", 5, None, None), ("nulls", 6, None, float("nan")), ("a", None, 1, 1.0), ("far", 0, 1, 1.0), ("far", 10 * 1440, 2, 3.0)]
    got = {(r.event_type, (r.day - ORIGIN.date()).days): (r.n_events, r.n_users, r.p50) for r in sketches.trailing_week(events(spark, rows)).collect()}
    want = {(None, 0): (2, 1, 2.0), ("nulls", 0): (2, 0, None), ("far", 10): (1, 1, 3.0)} | {("far", d): (1, 1, 1.0) for d in range(7)}
    assert got == want
    assert sketches.trailing_week(events(spark, rows).where("false")).count() == 0
