"""Row patterns against a plain matcher that tries every run of events."""

import datetime
import random
import re

import pytest

from tidemark.operators import patterns

HOUR = 3600_000_000


def plain(events, pattern, hours, overlapping):
    """(user, first, last, length) by regular expressions over each run of a user's events."""
    whole = re.compile("".join(f"{k}{q}" for k, q in pattern))
    by_user, out = {}, []
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        by_user.setdefault(e[2], []).append(e)
    for user, mine in by_user.items():
        text, free = "".join(e[3] for e in mine), 0
        for a in range(len(mine)):
            ends = [b for b in range(a, len(mine)) if mine[b][1] - mine[a][1] <= hours * 60 and whole.fullmatch(text, a, b + 1)]
            if ends and (overlapping or a >= free):
                out.append((user, mine[a][0], mine[ends[-1]][0], ends[-1] - a + 1))
                free = ends[-1] + 1
    return sorted(out, key=str)


def table(spark, events):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    return spark.createDataFrame([(i, at(m), u, k, "x") for i, m, u, k in events], "event_id long, ts timestamp_ntz, user_id long, event_type string, mask string")


def stream(seed, n, minutes, users=(1, 2, None)):
    rng = random.Random(seed)
    return [(k, rng.randrange(minutes), rng.choice(users), rng.choice("vvvsp")) for k in range(n)]


def mine(df):
    return sorted(((r.user_id, r.first_id, r.last_id, r.n_events) for r in df.collect()), key=str)


PATTERNS = [[("v", "+"), ("s", ""), ("p", "")], [("v", "*"), ("s", "?"), ("v", ""), ("p", "*")], [("v", ""), ("v", "")], [("v", "+")], [("s", "?"), ("p", "?"), ("v", "?")]]


@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize("k", range(len(PATTERNS)))
def test_matches_equal_the_plain_matcher(spark, k, overlapping):
    """Over several blocks of two hours, with ties in time and matches that end in the next block."""
    events = stream(k, 400, 1500)
    got = patterns.match_rows(table(spark, events), patterns.of_types(*PATTERNS[k]), 2, overlapping)
    assert mine(got) == plain(events, PATTERNS[k], 2, overlapping)


def test_one_busy_user_and_chains_over_many_blocks(spark):
    """Matches that follow each other without a gap, each crossing into the next block."""
    events = [(k, 25 * k, 1, "v") for k in range(300)]
    pattern = [("v", ""), ("v", ""), ("v", ""), ("v", "?")]
    for overlapping in (False, True):
        assert mine(patterns.match_rows(table(spark, events), patterns.of_types(*pattern), 1, overlapping)) == plain(events, pattern, 1, overlapping)


def test_long_runs_take_one_step_for_an_event():
    """100,000 first events in one state: as quick as the number of events, not of pairs."""
    n = 100_000
    found = patterns.longest_matches(patterns.Automaton(["+", ""]), [1] * n + [2], list(range(n + 1)), [True] * (n + 1), 10 * n)
    assert found == [(k, n) for k in range(n)]
    found = patterns.longest_matches(patterns.Automaton(["+"]), [1] * n, list(range(n)), [True] * n, 10)
    assert found == [(k, min(k + 10, n - 1)) for k in range(n)]


def test_no_events_no_time_and_nothing_that_fits(spark):
    pattern = patterns.of_types(("v", "+"))
    some = table(spark, stream(1, 20, 100))
    for overlapping in (False, True):
        assert patterns.match_rows(some.where("false"), pattern, 2, overlapping).count() == 0
        assert patterns.match_rows(some.selectExpr("event_id", "cast(null as timestamp_ntz) ts", "user_id", "event_type"), pattern, 2, overlapping).count() == 0
        assert patterns.match_rows(some, patterns.of_types(("none", "")), 2, overlapping).count() == 0
