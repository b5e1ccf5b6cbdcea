"""What changed between two snapshots of a table, repeated rows included, and how to apply it.

A snapshot is a multiset of rows.  Rows of the one count -1 and of the other +1, and one
aggregate over whole rows adds them up: what is left is EXCEPT ALL in both directions, from one
shuffle in which repeated rows are added up before they are sent.  That table of changes is
written once; a second aggregate of it, over keys, tells whether a key lost rows, gained rows or both.

Defined cases: nulls are equal to each other, in rows and in keys, as are NaNs, and 0.0 and
-0.0; rows may repeat any number of times; empty snapshots are snapshots; both must have the
same columns, in any order, and the names of the result's two columns must be free (other ones
can be given), otherwise an error is raised; columns must be of types that can be grouped by.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled

INSERTED, DELETED, CHANGED = "inserted", "deleted", "changed"
#: Copies of a row that come from one array.
COPIES = 65_536
#: Rows of the tables for each task of a join.
TASK_ROWS = 250_000


def difference(before: DataFrame, after: DataFrame, keys: list[str], kind: str = "change", copies: str = "copies") -> DataFrame:
    """Each row whose number of copies changed, with the kind of change of its key and by how many copies (less than 0: fewer)."""
    names = before.columns
    if set(names) != set(after.columns) or {kind, copies} & set(names):
        raise ValueError(f"snapshots need the same columns, none of them called {kind} or {copies}")
    return net_changes(before.withColumn(copies, F.lit(-1)).unionByName(after.withColumn(copies, F.lit(1))), keys, kind, copies)


def net_changes(both: DataFrame, keys: list[str], kind: str = "change", copies: str = "copies") -> DataFrame:
    """What is left when the copies of both snapshots' rows, less than 0 for those of the first, are added up."""
    names = [c for c in both.columns if c != copies]
    net = settled(both.groupBy(*names).agg(F.sum(copies).alias(copies)).where(F.col(copies) != 0))
    gains = net.groupBy(*[F.col(k).alias(f"__tm_{i}") for i, k in enumerate(keys)]).agg((F.max(copies) > 0).alias("__tm_more"), (F.min(copies) < 0).alias("__tm_fewer"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & net[k].eqNullSafe(gains[f"__tm_{i}"])
    of_key = F.when(F.col("__tm_more") & F.col("__tm_fewer"), CHANGED).when(F.col("__tm_more"), INSERTED).otherwise(DELETED)
    return net.join(gains, same).select(*names, of_key.alias(kind), copies)


def applied(before: DataFrame, changes: DataFrame, kind: str = "change", copies: str = "copies") -> DataFrame:
    """The snapshot after the changes, each row as often as it has copies."""
    names = before.columns
    rows = before.withColumn(copies, F.lit(1).cast("long")).unionByName(changes.drop(kind)).groupBy(*names).agg(F.sum(copies).alias(copies)).where(F.col(copies) > 0)
    parts = rows.select(*names, copies, F.explode(F.expr(f"sequence(0L, (`{copies}` - 1) div {COPIES})")).alias("__tm_part"))
    left = F.least(F.lit(COPIES), F.col(copies) - F.col("__tm_part") * COPIES).cast("int")
    return parts.withColumn("__tm_copy", F.explode(F.sequence(F.lit(1), left))).select(*names)


def tasks_for(*tables: DataFrame) -> int:
    """So many tasks that each gets about TASK_ROWS rows of the tables, however large they are."""
    return max(1, -(-sum(t.count() for t in tables) // TASK_ROWS))


def signed_lines(orders: DataFrame, lineitem: DataFrame, first: datetime.datetime, second: datetime.datetime, days: int = 365) -> DataFrame:
    """Lines of the orders placed in so many days up to either day, whether they had been shipped by then, and copies: -1 for the first day, 1 for the second.

    Orders and lines meet once for both days, in a number of tasks that follows the tables, so
    what a task puts in order stays the same.
    """
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    placed = lambda day: (F.col("o_orderdate") > at(day - datetime.timedelta(days=days))) & (F.col("o_orderdate") <= at(day))
    state = lambda day: F.when(F.col("l_shipdate") <= at(day), "shipped").otherwise("waiting")
    tasks = tasks_for(orders, lineitem)
    recent = orders.where(placed(first) | placed(second)).select("o_orderkey", "o_custkey", "o_orderdate").repartition(tasks, "o_orderkey")
    lines = lineitem.select("l_orderkey", "l_returnflag", "l_shipdate").repartition(tasks, "l_orderkey")
    both = recent.join(lines, recent["o_orderkey"] == lines["l_orderkey"])
    each = [F.when(placed(day), F.struct(state(day).alias("state"), F.lit(sign).alias("copies"))) for day, sign in ((first, -1), (second, 1))]
    return both.select("o_orderkey", "o_custkey", "l_returnflag", F.explode(F.array_compact(F.array(*each))).alias("__tm_day")).select("o_orderkey", "o_custkey", "l_returnflag", "__tm_day.*")


def order_line_changes(orders: DataFrame, lineitem: DataFrame, first: datetime.datetime, second: datetime.datetime) -> DataFrame:
    """How the lines of recent orders changed from one day to the other, by order."""
    return net_changes(signed_lines(orders, lineitem, first, second), ["o_orderkey"])
