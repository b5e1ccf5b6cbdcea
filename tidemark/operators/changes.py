"""Points at which the hourly count of a kind of event changes, by cumulative sums.

For each kind the sum of how far its counts exceed their mean, less an allowance, is carried
from hour to hour and never falls below 0; likewise the sum of how far they stay below.  A sum
that passes the limit is a change: it began in the hour after the sum last was 0.  The sum with
its floor at 0 is a prefix sum less the least prefix so far, so windows give it; sums are whole
thousandths of an event and thus exact.  Events are counted before anything is put in order, so
a window holds a row for each hour of a kind, however many events there are.

Allowance and limit are in standard deviations of the hourly counts between the kind's first
and last hour, empty hours included.  Defined cases: events without ts are left out; a null kind
is a kind; a kind with equal counts in all hours has no changes; repeated rows count; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import micros
from ..sources.scratch import settled

HOUR = 3_600_000_000


def hourly_counts(events: DataFrame) -> DataFrame:
    """kind, hour, n for each hour from a kind's first to its last, with hours, total and squares of the kind."""
    held = events.where(F.col("ts").isNotNull()).groupBy(F.col("event_type").alias("kind"), F.floor(micros(F.col("ts")) / HOUR).alias("hour"))
    held = settled(held.agg(F.count("*").alias("n")))  # read for the kinds and for the grid
    square = F.sum((F.col("n") * F.col("n")).cast("decimal(28,0)")).cast("double")
    kinds = held.groupBy("kind").agg(F.min("hour").alias("first"), F.max("hour").alias("last"), F.sum("n").cast("double").alias("total"), square.alias("squares"))
    kinds = kinds.withColumn("hours", (F.col("last") - F.col("first") + 1).cast("double"))
    grid = kinds.select("kind", "hours", "total", "squares", F.explode(F.sequence("first", "last")).alias("hour"))
    held = held.select(F.col("kind").alias("h_kind"), F.col("hour").alias("h_hour"), "n")
    return grid.join(held, F.col("kind").eqNullSafe(F.col("h_kind")) & (F.col("hour") == F.col("h_hour")), "left").select("kind", "hour", F.coalesce("n", F.lit(0)).alias("n"), "hours", "total", "squares")


def change_points(events: DataFrame, allowance: float = 0.5, limit: float = 5.0) -> DataFrame:
    """One row for each change: kind of event, direction, first hour, hour of the alarm, last hour, peak of the sum."""
    deviation = F.sqrt(F.greatest(F.col("hours") * F.col("squares") - F.col("total") * F.col("total"), F.lit(0.0)))
    thousandths = lambda x: F.floor(x).cast("long")
    mean, spare = 1000.0 * F.col("total") / F.col("hours"), 1000 * allowance * F.col("deviation") / F.col("hours")
    rows = hourly_counts(events).withColumn("deviation", deviation).withColumn("limit", thousandths(1000 * limit * F.col("deviation") / F.col("hours")))
    step = lambda name, by: F.struct(F.lit(name).alias("direction"), by.alias("step"))
    both = F.array(step("up", 1000 * F.col("n") - thousandths(mean + spare)), step("down", thousandths(mean - spare) - 1000 * F.col("n")))
    rows = rows.select("kind", "hour", "limit", F.explode(both).alias("s")).select("kind", "hour", "limit", "s.*")
    so_far = Window.partitionBy("kind", "direction").orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("prefix", F.sum("step").over(so_far))
    rows = rows.withColumn("held", F.col("prefix") - F.least(F.lit(0), F.min("prefix").over(so_far)))
    rows = rows.withColumn("run", F.sum((F.col("held") == 0).cast("int")).over(so_far)).where("held > 0")
    at = lambda hour: F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, cast({hour} as int))")
    found = rows.groupBy("kind", "direction", "run").agg(
        F.min("hour").alias("first"), F.min(F.when(F.col("held") > F.col("limit"), F.col("hour"))).alias("alarm"), F.max("hour").alias("last"), F.max("held").alias("peak")
    )
    return found.where("alarm is not null").select(F.col("kind").alias("event_type"), "direction", at("first").alias("begins"), at("alarm").alias("alarm"), at("last").alias("ends"), F.col("peak").alias("peak_milli"))
