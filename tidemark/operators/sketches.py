"""Hourly states of events that answer for any range of hours: distinct users and quantiles of values.

An hour of a kind of event is one row: the number of its events, a HyperLogLog sketch of its
users and a KLL sketch of its values.  Rows are merged and never recomputed: those of late events
are added as further rows of their hour, hours are rolled up to days, and a range is the
merge of the rows in it.  A row has a bounded size (about 2 KiB for users and 4 KiB for
values), so what a range costs depends on its hours and not on its events.

Errors as stated for these sketches: 1.04 / sqrt(2^precision) of the number of users as standard
error (1.6 % at 12), and about 1.4 % of the events in the rank of a quantile (k = 200, at 99 %
confidence).  Small sketches are exact.  KLL tosses coins, so quantiles of two builds may differ
within that error.

Defined cases: events without ts are left out; a null kind is a kind; a null user is no user,
and null and NaN values are none, though their events count; quantiles of no values are null;
repeated rows count as events; other columns, whatever their names, are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import micros

HOUR = 3_600_000_000
STATE = ("n_events", "users", "values")


def hourly_states(events: DataFrame, precision: int = 12, k: int = 200) -> DataFrame:
    """kind, hour (since 1970), n_events, users, values: one row for each hour in which a kind has events."""
    at = events.where(F.col("ts").isNotNull()).select(
        F.col("event_type").alias("kind"), F.floor(micros(F.col("ts")) / HOUR).alias("hour"), "user_id", F.when(~F.isnan("value"), F.col("value")).alias("value")
    )
    users, values = F.hll_sketch_agg("user_id", F.lit(precision)), F.kll_sketch_agg_double("value", F.lit(k))
    return at.groupBy("kind", "hour").agg(F.count("*").alias("n_events"), users.alias("users"), values.alias("values"))


def merged(states: DataFrame, *by: str) -> DataFrame:
    """One state for each value of the columns."""
    users, values = F.hll_union_agg("users"), F.kll_merge_agg_double("values")
    return states.groupBy(*by).agg(F.sum("n_events").alias("n_events"), users.alias("users"), values.alias("values"))


def answers(states: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The states' columns replaced by n_events, n_users and the named quantiles."""
    value = lambda at: F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(at)))
    found = [value(at).alias(name) for name, at in quantiles.items()]
    return states.select(*[c for c in states.columns if c not in STATE], "n_events", F.hll_sketch_estimate("users").alias("n_users"), *found)


def between(states: DataFrame, first_hour: int, last_hour: int) -> DataFrame:
    """The state of each kind from the first to the last hour, both included."""
    return merged(states.where(F.col("hour").between(first_hour, last_hour)), "kind")


def trailing_days(states: DataFrame, days: int = 7) -> DataFrame:
    """The state of each kind at every day from its first to its last, over the days up to and with it.

    Hours are rolled up to days first; a day goes to the days that look back on it.
    """
    daily = merged(states.withColumn("day", F.floor(F.col("hour") / 24)), "kind", "day")
    last = daily.groupBy(F.col("kind").alias("last_kind")).agg(F.max("day").alias("last"))
    reach = F.sequence(F.col("day"), F.least(F.col("last"), F.col("day") + days - 1))
    held = daily.join(last, F.col("kind").eqNullSafe(F.col("last_kind"))).withColumn("day", F.explode(reach))
    return merged(held, "kind", "day")


def trailing_week(events: DataFrame) -> DataFrame:
    """event_type, day, n_events, n_users, p50 and p95 of seven days up to each day (days without events on any of them are left out)."""
    found = answers(trailing_days(hourly_states(events)), {"p50": 0.5, "p95": 0.95})
    return found.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))).withColumnRenamed("kind", "event_type")
