"""Operators on streams of events, with bounded state.

Event time needs a timestamp with a time zone, so ts is cast; the session time zone
should be UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Count and largest value for each user and window; a window's state goes with the watermark."""
    window = F.window("at", width)
    counts = timed(events, late).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n_events"), F.max("value").alias("max_value"))
    return counts.select("user_id", F.col("w.start").alias("start"), "n_events", "max_value")


def sequence_match(events: DataFrame, first: str = "signup", then: str = "purchase", hours: int = 6, late: str = LATE) -> DataFrame:
    """A first and a later event of the same user within so many hours, as both arrive."""
    a = timed(events.where(F.col("event_type") == first), late).select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("at").alias("a"))
    b = timed(events.where(F.col("event_type") == then), late).select(F.col("user_id").alias("b_user"), F.col("event_id").alias("then_id"), F.col("at").alias("b"))
    soon = (F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + F.expr(f"INTERVAL {hours} HOURS"))
    return a.join(b, (F.col("user_id") == F.col("b_user")) & soon).select("user_id", "first_id", "then_id")
