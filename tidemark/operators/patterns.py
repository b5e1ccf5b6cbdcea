"""Row patterns over events: runs of consecutive events of a user that fit a pattern within some hours.

A pattern is a list of elements (name, quantifier, condition), the quantifier "", "?", "+" or
"*".  A match is a run of consecutive events of one user, in order of ts and event_id, that
the elements fit one after the other, and whose last event lies at most so many hours after
its first.  From each first event the longest match counts.  With ``overlapping`` every first
event has its match; without, matches are taken from left to right, each beginning after
the end of the one before.

Which conditions hold is a column.  A user's events are cut into blocks as long as a match
may be, and a block also gets the events of the next one, so every match lies in the block in
which it begins.  There an automaton runs over the events, all first events at once: those
whose sets of states have become equal go on as one, so an event costs as many steps as
there are different sets, however long the runs are.

What is taken without overlaps depends on everything before.  So a block also says where
the matches taken in it would end in the next block, for each place at which the last match
of the block before can end; these are put together block by block, one row for each, and
then each block takes its matches.  A task holds the events of a user in two blocks at a
time, never all events or all matches of a user.

Defined cases: a null user is a user; an event without ts is in no run; a condition that is null does not hold; events alike
in ts and event_id may be taken in any order; an empty match is none; a pattern that no event
fits, and an empty table, give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import micros
from ..sources.scratch import settled
from .events import BLOCK, HOUR, OWN, block_of


class Automaton:
    """Sets of elements as bits: which come first, which follow each, which may be the last."""

    def __init__(self, quantifiers: list[str]):
        n = len(quantifiers)
        skips, repeats = [q in ("?", "*") for q in quantifiers], [q in ("+", "*") for q in quantifiers]

        def after(k: int) -> int:
            out = 0
            while k < n:
                out |= 1 << k
                if not skips[k]:
                    break
                k += 1
            return out

        self.first = after(0)
        self.follow = [after(k + 1) | (repeats[k] << k) for k in range(n)]
        self.last = sum(1 << k for k in range(n) if all(skips[k + 1 :]))
        self.known = {0: 0}

    def after(self, states: int) -> int:
        if states not in self.known:
            self.known[states] = 0
            for k, follow in enumerate(self.follow):
                if states >> k & 1:
                    self.known[states] |= follow
        return self.known[states]


def longest_matches(automaton: Automaton, masks: list[int], times: list[int], own: list[bool], most: int) -> list[tuple[int, int]]:
    """(first, last) of the longest match from each own event, in order of the first.

    Events that began at different places and reached the same states hang under one node; a
    node's stamp is the last event at which all under it had a match.
    """
    parent: list[int] = []
    stamp: list[int] = []
    begun: list[tuple[int, int]] = []  # event, node
    now: dict[int, int] = {}  # states -> node
    out, done = [], 0

    def node() -> int:
        parent.append(len(parent))
        stamp.append(-1)
        return len(parent) - 1

    def last_of(x: int) -> int:
        path = []
        while parent[x] != x:
            path.append(x)
            x = parent[x]
        best = -1
        for y in reversed(path):  # from the top, so that each gets the largest stamp above it
            best = max(best, stamp[y])
            stamp[y], parent[y] = best, x
        return max(best, stamp[x])

    def put(to: dict[int, int], states: int, x: int) -> None:
        if states in to:
            top = node()
            parent[to[states]] = parent[x] = top
            x = top
        to[states] = x

    def end(until: int) -> None:
        nonlocal done
        while done < len(begun) and times[begun[done][0]] + most < until:
            first, x = begun[done]
            last = last_of(x)
            if last >= 0:
                out.append((first, last))
            done += 1

    for k, mask in enumerate(masks):
        end(times[k])
        if done == len(begun):
            now = {}
        following: dict[int, int] = {}
        for states, x in now.items():
            to = automaton.after(states) & mask
            if to:
                put(following, to, x)
        if own[k] and automaton.first & mask:
            begun.append((k, node()))
            put(following, automaton.first & mask, begun[-1][1])
        now = following
        for states, x in now.items():
            if states & automaton.last:
                stamp[x] = k
    end(1 << 62)
    return out


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[dict]]:
    """The rows of each group; rows come sorted by key."""
    held: list[dict] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            mine = tuple(row[k] for k in key)
            if held and mine != last:
                yield held
                held = []
            held.append(row)
            last = mine
    if held:
        yield held


def within_block(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("user_id", BLOCK).sortWithinPartitions("user_id", BLOCK, *order)


FOUND = f"user_id {{user}}, {BLOCK} long, s_at long, first_id long, e_at long, last_id long, n_events long, x_at long, x_id long"


def candidates(events: DataFrame, pattern: list[tuple[str, str, Column]], hours: int) -> DataFrame:
    """The longest match from every first event, and x: where taking it would lead to in a later block."""
    automaton, most = Automaton([q for _, q, _ in pattern]), hours * HOUR
    mask = sum((F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0) for k, (_, _, c) in enumerate(pattern)), F.lit(0))
    rows = events.where(F.col("ts").isNotNull()).withColumn(OWN, F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(BLOCK, block_of(hours) - F.when(F.col(OWN), 0).otherwise(1))
    rows = within_block(rows.select("user_id", BLOCK, micros(F.col("ts")).alias("at"), "event_id", mask.cast("long").alias("mask"), F.col(OWN).alias("own")), "at", "event_id")
    user = dict(events.dtypes)["user_id"]
    names = ["user_id", BLOCK, "s_at", "first_id", "e_at", "last_id", "n_events", "x_at", "x_id"]
    schema = pa.schema([(n, pa.int64()) for n in names]).set(0, pa.field("user_id", pa.string() if user == "string" else pa.int64()))

    def chains(found: list[tuple[int, int]], rows: list[dict]) -> list[int | None]:
        """For each match where the last of those taken from it on ends, if that is in a later block."""
        leads: list[int | None] = [None] * len(found)
        at = {}  # first match that begins at or after an event
        k = len(found)
        for event in range(len(rows), -1, -1):
            while k and found[k - 1][0] >= event:
                k -= 1
            at[event] = k
        for k in range(len(found) - 1, -1, -1):
            last = found[k][1]
            following = at[last + 1]
            leads[k] = last if not rows[last]["own"] else leads[following] if following < len(found) else None
        return leads

    def run(batches):
        out: list[tuple] = []

        def batch():
            made = pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema)
            out.clear()
            return made

        for rows in groups(batches, ["user_id", BLOCK]):
            found = longest_matches(automaton, [r["mask"] for r in rows], [r["at"] for r in rows], [r["own"] for r in rows], most)
            for (a, b), x in zip(found, chains(found, rows) if found else [], strict=True):
                end = (rows[x]["at"], rows[x]["event_id"]) if x is not None else (None, None)
                out.append((rows[a]["user_id"], rows[a][BLOCK], rows[a]["at"], rows[a]["event_id"], rows[b]["at"], rows[b]["event_id"], b - a + 1, *end))
            if len(out) >= 10_000:
                yield batch()
        yield batch()

    return rows.mapInArrow(run, FOUND.format(user=user))


def entered(found: DataFrame, hours: int) -> DataFrame:
    """user, block, and where the last match taken before ends, if that is in the block."""
    user = dict(found.dtypes)["user_id"]
    lead = F.struct(F.col("x_at").alias("at"), F.col("x_id").alias("id"))
    crossing = found.where(F.col("x_at").isNotNull()).select("user_id", F.floor(F.col("x_at") / (hours * HOUR)).alias(BLOCK), F.col("x_at").alias("at"), F.col("x_id").alias("id")).distinct()
    marks = found.select("user_id", BLOCK, F.col("s_at").alias("at"), F.col("first_id").alias("id"), F.struct(lead.alias("lead")).alias("begins"))
    marks = marks.unionByName(crossing.withColumn("begins", F.lit(None)), allowMissingColumns=True)
    after = Window.partitionBy("user_id", BLOCK).orderBy("at", "id", F.col("begins").isNull()).rowsBetween(1, Window.unboundedFollowing)
    leads = marks.withColumn("next", F.first("begins", ignorenulls=True).over(after)).where(F.col("begins").isNull()).select("user_id", BLOCK, "at", "id", "next.lead")
    free = found.groupBy("user_id", BLOCK).agg(F.min_by(lead, F.struct("s_at", "first_id")).alias("lead"))
    ways = leads.unionByName(free, allowMissingColumns=True)
    ways = ways.select("user_id", BLOCK, "at", "id", F.col("lead.at").alias("to_at"), F.col("lead.id").alias("to_id")).repartition("user_id").sortWithinPartitions("user_id", BLOCK)

    def run(batches):
        """Follows the blocks of each user from the first on."""
        user_id, block, came, out = None, None, (None, None), []
        for rows in groups(batches, ["user_id", BLOCK]):
            if rows[0]["user_id"] != user_id or rows[0][BLOCK] != block:
                came = (None, None)  # nothing leads here from the block before
            lead = {(r["at"], r["id"]): (r["to_at"], r["to_id"]) for r in rows}
            out.append({"user_id": rows[0]["user_id"], BLOCK: rows[0][BLOCK], "in_at": came[0], "in_id": came[1]})
            user_id, block, came = rows[0]["user_id"], rows[0][BLOCK] + 1, lead.get(came, (None, None))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("user_id", pa.string() if user == "string" else pa.int64()), (BLOCK, pa.int64()), ("in_at", pa.int64()), ("in_id", pa.int64())])
    return ways.mapInArrow(run, f"user_id {user}, {BLOCK} long, in_at long, in_id long")


def taken(found: DataFrame, came: DataFrame) -> DataFrame:
    """The matches of each block from left to right, after where the last one before it ends."""
    both = within_block(found.drop("x_at", "x_id").unionByName(came, allowMissingColumns=True), "s_at", "first_id")

    def run(batches):
        last = (-(1 << 63), 0)
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("s_at", "first_id", "e_at", "last_id", "in_at", "in_id"))
            for s_at, first_id, e_at, last_id, in_at, in_id in zip(*columns, strict=True):
                begins = s_at is None  # the row that says where the last match before the block ends
                keep.append(not begins and (s_at, first_id) > last)
                if begins:
                    last = (in_at, in_id) if in_at is not None else (-(1 << 63), 0)
                elif keep[-1]:
                    last = (e_at, last_id)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, both.schema)


def match_rows(events: DataFrame, pattern: list[tuple[str, str, Column]], hours: int = 24, overlapping: bool = False) -> DataFrame:
    """user_id, first_id, last_id, n_events and span_us of each match."""
    found = candidates(events, pattern, hours)
    if not overlapping:
        found = settled(found)
        found = taken(found, entered(found, hours))
    return found.select("user_id", "first_id", "last_id", "n_events", (F.col("e_at") - F.col("s_at")).alias("span_us"))


def of_types(*elements: tuple[str, str]) -> list[tuple[str, str, Column]]:
    """A pattern of kinds of event, each with its quantifier."""
    return [(kind, quantifier, F.col("event_type") == kind) for kind, quantifier in elements]
