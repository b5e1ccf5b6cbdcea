"""The event queries and their SQL, by name."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, dense, isolation, patterns, shredding, sketches, snapshots
from ..operators import events as ops
from ..sources.tables import table


def _on_events(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "events"))


def _zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded, since engines differ in the last digits of a standard deviation."""
    return ops.value_zscore(table(spark, sf_dir, "events")).withColumn("zscore", F.round("zscore", 6))


def _velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.velocity(table(spark, sf_dir, "events")).withColumn("sum_value", F.round("sum_value", 4))


#: Views, then a signup, then a purchase, within a day.
FUNNEL = (("view", "+"), ("signup", ""), ("purchase", ""))


def _funnel(overlapping: bool):
    return lambda spark, sf_dir: patterns.match_rows(table(spark, sf_dir, "events"), patterns.of_types(*FUNNEL), 24, overlapping)


def _decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.decayed_velocity(table(spark, sf_dir, "events")).withColumn("decayed", F.round("decayed", 6))


def _isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.isolation_scores(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between New Year and midsummer of 1997, as both days' snapshots lie within the orders."""
    days = datetime.datetime(1997, 1, 1), datetime.datetime(1997, 7, 1)
    return snapshots.order_line_changes(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), *days)


def _event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.shredded(table(spark, sf_dir, "events").select("event_id", "props"), "props")


def _dense_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_block(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def queries() -> dict:
    return {
        "velocity_1h": _velocity,
        "gap_since_previous": _on_events(ops.gap_since_previous),
        "distinct_types_1h": _on_events(ops.distinct_types),
        "value_zscore": _zscore,
        "value_percentile": _on_events(ops.value_percentile),
        "hourly_profile": _on_events(ops.hourly_profile),
        "user_sessions": _on_events(ops.user_sessions),
        "signup_then_purchase": _on_events(ops.sequence_match),
        "last_signup_before_purchase": _on_events(ops.last_before),
        "risk_score": _on_events(ops.risk_score),
        "view_signup_purchase": _funnel(False),
        "view_signup_purchase_overlapping": _funnel(True),
        "overlapping_sessions": _on_events(ops.overlapping_sessions),
        "decayed_velocity": _decayed,
        "change_points": _on_events(changes.change_points),
        "order_isolation": _isolation,
        "order_line_changes": _line_changes,
        "event_props": _event_props,
        "dense_block": _dense_block,
        "trailing_week": _on_events(sketches.trailing_week),
    }


SESSIONS = """
            WITH g AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS fresh FROM events),
            n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
            s AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM n GROUP BY user_id, k)"""
#: For each view the next event that is none, and the one after that.
FUNNELS = """
            WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
            o AS (SELECT *, min(CASE WHEN event_type <> 'view' THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r2 FROM n),
            m AS (SELECT v.user_id, v.event_id AS first_id, p.event_id AS last_id, p.r - v.r + 1 AS n_events, epoch_us(p.ts) - epoch_us(v.ts) AS span_us
                  FROM o v JOIN n s ON s.user_id = v.user_id AND s.r = v.r2 AND v.event_type = 'view' AND s.event_type = 'signup'
                  JOIN n p ON p.user_id = v.user_id AND p.r = v.r2 + 1 AND p.event_type = 'purchase' AND p.ts <= v.ts + INTERVAL 24 HOUR)"""

#: Both sums carried hour by hour.
CHANGES = """
            WITH RECURSIVE h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
            t AS (SELECT event_type, min(hour) AS first, max(hour) AS last, (max(hour) - min(hour) + 1)::DOUBLE AS hours, sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares FROM h GROUP BY ALL),
            k AS (SELECT *, sqrt(greatest(hours * squares - total * total, 0)) AS deviation FROM t),
            d AS (SELECT event_type, first, last, floor(5000 * deviation / hours)::BIGINT AS most,
                         floor(1000 * total / hours + 500 * deviation / hours)::BIGINT AS above, floor(1000 * total / hours - 500 * deviation / hours)::BIGINT AS below FROM k),
            w AS (SELECT event_type, unnest(['up', 'down']) AS direction, first - 1 AS hour, 0::BIGINT AS held, 0::BIGINT AS run FROM d
                  UNION ALL
                  SELECT event_type, direction, hour, greatest(0, held), run + (held <= 0)::INT FROM (
                      SELECT w.event_type, w.direction, w.hour + 1 AS hour, w.run,
                             w.held + CASE WHEN w.direction = 'up' THEN 1000 * coalesce(h.n, 0) - d.above ELSE d.below - 1000 * coalesce(h.n, 0) END AS held
                      FROM w JOIN d ON d.event_type IS NOT DISTINCT FROM w.event_type
                      LEFT JOIN h ON h.event_type IS NOT DISTINCT FROM w.event_type AND h.hour = w.hour + 1 WHERE w.hour < d.last))
            SELECT w.event_type, direction, make_timestamp(min(hour) * 3600000000) AS begins, make_timestamp(min(hour) FILTER (held > most) * 3600000000) AS alarm,
                   make_timestamp(max(hour) * 3600000000) AS ends, max(held) AS peak_milli
            FROM w JOIN d ON d.event_type IS NOT DISTINCT FROM w.event_type WHERE held > 0 GROUP BY w.event_type, direction, run, most HAVING max(held) > most"""

#: Pairs of each round; of the side that is peeled those stay that are heavier than 1.1 of its mean.
PEELING = """
            WITH RECURSIVE e AS (SELECT o_custkey AS c, l_suppkey AS s, count(*) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey
                                 WHERE o_custkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY ALL),
            z AS (SELECT count(DISTINCT c) AS c0, count(DISTINCT s) AS s0 FROM e),
            p AS (SELECT 1 AS k, c, s, w FROM e
                  UNION ALL
                  SELECT k + 1, c, s, w FROM (
                      SELECT *, sum(w) OVER () AS total, sum(w) OVER (PARTITION BY c) AS wc, sum(w) OVER (PARTITION BY s) AS ws,
                             count(DISTINCT c) OVER () AS nc, count(DISTINCT s) OVER () AS ns FROM p), z
                  WHERE CASE WHEN nc * s0 >= c0 * ns THEN 100 * wc * nc > 110 * total ELSE 100 * ws * ns > 110 * total END),
            d AS (SELECT k, sum(w)::DOUBLE / sqrt((count(DISTINCT c) * count(DISTINCT s))::DOUBLE) AS density FROM p GROUP BY k),
            b AS (SELECT k, density FROM d ORDER BY density DESC, k LIMIT 1),
            m AS (SELECT 'customer' AS side, c AS member, max(k) AS rounds FROM p GROUP BY c UNION ALL SELECT 'supplier', s, max(k) FROM p GROUP BY s)
            SELECT side, member, rounds, rounds >= b.k AS in_block, density FROM m, b"""


def oracle_sql() -> dict[str, str]:
    hour = "PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW"
    return {
        "velocity_1h": f"SELECT event_id, user_id, count(*) OVER w AS n_events, round(sum(value) OVER w, 4) AS sum_value FROM events WINDOW w AS ({hour})",
        "gap_since_previous": "SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events",
        "distinct_types_1h": f"SELECT event_id, user_id, count(DISTINCT event_type) OVER ({hour}) AS n_types FROM events",
        "value_zscore": "SELECT event_id, user_id, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 6) AS zscore FROM events WINDOW w AS (PARTITION BY user_id)",
        "value_percentile": "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type",
        "hourly_profile": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
        "user_sessions": f"{SESSIONS} SELECT * FROM s",
        "overlapping_sessions": f"""{SESSIONS}
            SELECT a.user_id AS user_a, a.first_ts AS first_a, b.user_id AS user_b, b.first_ts AS first_b,
                   least(epoch_us(a.last_ts), epoch_us(b.last_ts)) - greatest(epoch_us(a.first_ts), epoch_us(b.first_ts)) AS overlap_us
            FROM s a JOIN s b ON a.user_id < b.user_id AND a.first_ts <= b.last_ts AND b.first_ts <= a.last_ts""",
        "view_signup_purchase_overlapping": f"{FUNNELS} SELECT * FROM m",
        "view_signup_purchase": f"""{FUNNELS}
            SELECT user_id, arg_max(first_id, n_events) AS first_id, last_id, max(n_events) AS n_events, max(span_us) AS span_us FROM m GROUP BY user_id, last_id""",
        "decayed_velocity": """
            SELECT e.event_id, e.user_id, round(sum(coalesce(o.value, 0) * pow(2.0, -(epoch_us(e.ts) - epoch_us(o.ts)) / 21600000000.0)), 6) AS decayed
            FROM events e JOIN events o ON o.user_id = e.user_id AND o.ts <= e.ts GROUP BY e.event_id, e.user_id""",
        "change_points": CHANGES,
        "dense_block": PEELING,
        "event_props": """
            SELECT event_id, CASE WHEN json_valid(props) THEN (props->>'$.k')::BIGINT END AS p_k,
                   CASE WHEN NOT coalesce(json_valid(props) AND json_type(props) = 'OBJECT', false) THEN props END AS rest, coalesce(NOT json_valid(props), false) AS malformed FROM events""",
        "order_line_changes": """
            WITH s AS (SELECT day, o_orderkey, o_custkey, l_returnflag, CASE WHEN l_shipdate <= day THEN 'shipped' ELSE 'waiting' END AS state
                       FROM (VALUES (TIMESTAMP '1997-01-01'), (TIMESTAMP '1997-07-01')) v(day) JOIN orders ON o_orderdate > day - INTERVAL 365 DAY AND o_orderdate <= day
                       JOIN lineitem ON l_orderkey = o_orderkey),
            a AS (SELECT * EXCLUDE (day) FROM s WHERE day = TIMESTAMP '1997-01-01'), b AS (SELECT * EXCLUDE (day) FROM s WHERE day = TIMESTAMP '1997-07-01'),
            c AS (SELECT *, -1 AS sign FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
            SELECT o_orderkey, o_custkey, l_returnflag, state, kind AS change, sum(sign)::BIGINT AS copies
            FROM c JOIN (SELECT o_orderkey, CASE WHEN count(DISTINCT sign) > 1 THEN 'changed' WHEN min(sign) > 0 THEN 'inserted' ELSE 'deleted' END AS kind FROM c GROUP BY o_orderkey) USING (o_orderkey)
            GROUP BY ALL""",
        "signup_then_purchase": """
            SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b
            ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""",
        "last_signup_before_purchase": """
            SELECT p.event_id, p.user_id, s.event_id AS last_first_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
            ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""",
        "risk_score": """
            WITH r AS (
                SELECT event_id, user_id, count(*) OVER h >= 2 AS r_velocity,
                       coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER o) < 600000000, false) AS r_gap,
                       count(DISTINCT event_type) OVER h >= 2 AS r_types,
                       coalesce(abs(value - avg(value) OVER u) > 2.5 * stddev_samp(value) OVER u, false) AS r_outlier,
                       event_type = 'purchase' AND EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts < e.ts AND s.ts >= e.ts - INTERVAL 6 HOUR) AS r_sequence
                FROM events e WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY ts, event_id),
                    h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))
            SELECT *, (25 * r_velocity::INT + 15 * r_gap::INT + 10 * r_types::INT + 30 * r_outlier::INT + 20 * r_sequence::INT)::INT AS score FROM r""",
    }
