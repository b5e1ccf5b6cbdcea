"""Running velocity and first-seen alerts for each user, in order of event time.

Events may come in any order.  A processor keeps them for each user until the watermark has
passed them, so that nothing earlier can come any more, and only then judges them in order of
ts and event_id.  What it says of an event thus depends neither on how the stream was cut
into batches nor on restarts, and equals what a batch over the same events says.  Events later
than the watermark are dropped, as in any aggregate with a watermark.

State of a user: the events that wait, counts and sums of the trailing hours, and when each
kind of event was last seen.  Timers in event time release the events, and forget a kind that
was not seen for ``forget_days`` (Spark's own time to live runs on the clock, not on event time).
State of a user is in one task; it holds the events of the trailing hours and of the
allowed delay, not the user's past.

The session needs RocksDB for state (spark.sql.streaming.stateStore.providerClass).

Defined cases: a null user is a user; a null value adds nothing; a null event_type is a kind of
its own; events that come twice count twice; events without ts are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import LATE, timed

HOUR, DAY = 3_600_000_000, 86_400_000_000
COLUMNS = ["user_id", "event_id", "us", "n_events", "sum_value", "first_seen"]


class Alerts(StatefulProcessor):
    """us: microseconds of ts; a kind is the event_type behind a mark, or "" for null."""

    def __init__(self, hours: int, forget_days: int):
        self.span, self.forget = hours * HOUR, forget_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long", "events array<struct<event_id: long, kind: string, value: double>>")
        self.recent = handle.getMapState("recent", "us long", "n long, total double")
        self.seen = handle.getMapState("seen", "kind string", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for us, part in batch.groupby("us"):
                us = int(us)
                before = [tuple(e) for e in self.waiting.getValue((us,))[0]] if self.waiting.containsKey((us,)) else []
                value = [None if pd.isna(v) else float(v) for v in part["value"]]
                self.waiting.updateValue((us,), (before + list(zip(map(int, part["event_id"]), part["kind"], value, strict=True)),))
                self.handle.registerTimer(-(-us // 1000))
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        out = []
        recent = {k[0]: tuple(v) for k, v in self.recent.iterator()}
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        for us in sorted(k[0] for k in list(self.waiting.keys()) if k[0] <= until):
            events = sorted((tuple(e) for e in self.waiting.getValue((us,))[0]), key=lambda e: e[0])
            self.waiting.removeKey((us,))
            values = [e[2] for e in events if e[2] is not None]
            recent[us] = (len(events), float(sum(values)))
            self.recent.updateValue((us,), recent[us])
            for old in [k for k in recent if k < us - self.span]:
                del recent[old]
                self.recent.removeKey((old,))
            n, total = sum(r[0] for r in recent.values()), sum(r[1] for r in recent.values())
            for event_id, kind, _ in events:
                out.append((key[0], event_id, us, n, total, kind not in seen or us - seen[kind] > self.forget))
                seen[kind] = us
                self.seen.updateValue((kind,), (us,))
                self.handle.registerTimer(-(-(us + self.forget) // 1000) + 1)
        for kind in [k for k, us in seen.items() if us + self.forget < until]:
            self.seen.removeKey((kind,))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def alerts(events: DataFrame, hours: int = 1, forget_days: int = 7, late: str = LATE) -> DataFrame:
    """event_id, user_id, ts, n_events, sum_value (of the trailing hours) and first_seen for each event of a stream."""
    kind = F.coalesce(F.concat(F.lit("="), "event_type"), F.lit(""))
    rows = timed(events.where(F.col("ts").isNotNull()), late).select("user_id", "event_id", "at", F.unix_micros("at").alias("us"), kind.alias("kind"), F.col("value").cast("double").alias("value"))
    user = dict(events.dtypes)["user_id"]
    out = rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Alerts(hours, forget_days), outputStructType=f"user_id {user}, event_id long, us long, n_events long, sum_value double, first_seen boolean", outputMode="append", timeMode="EventTime"
    )
    return out.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), "n_events", "sum_value", "first_seen")
