"""Streams over events, run to completion, and sources: each is held against its batch form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.plans.graded_queries import rounded
from gradeloom.plans.tables import table
from gradeloom.sources import spans
from gradeloom.streaming import monitor, windows


def tumbling_usage(spark, sf):
    return rounded(windows.drained(windows.tumbling(windows.event_stream(spark, sf), "1 day"), "tumbling_usage"))


def sliding_usage(spark, sf):
    return rounded(windows.drained(windows.sliding(windows.event_stream(spark, sf), "7 days", "1 day"), "sliding_usage"))


def session_usage(spark, sf):
    return windows.drained(windows.sessions(windows.event_stream(spark, sf), "30 minutes"), "session_usage")


def deduplicated_events(spark, sf):
    out = windows.drained(windows.deduplicated(windows.event_stream(spark, sf), ["event_id"]), "deduplicated_events")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").cast("long").alias("users"))


def running_means(spark, sf):
    return windows.drained(monitor.running_mean(windows.event_stream(spark, sf)), "running_means", "update").groupBy("event_type").agg(F.max("n").alias("n"), F.round(F.max_by("mean", "n"), 4).alias("mean"))


def monitor_alarms(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("proxy"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("gold"), F.avg(F.length("props")).alias("length"))
    points = days.withColumn("step", F.datediff("day", F.lit("1990-01-01")).cast("long"))
    return rounded(monitor.alarms(points.select("step", "proxy", "gold", "length"), window=3, delta=0.02))


def span_conversations(spark, sf):
    return spans.conversations(table(spark, sf, "events"), conversation="user_id", start="ts", kind="event_type", key="event_id").select("user_id", "spans", "faults", "first_kind", "last_kind", "total_value")


def coverage_curve(spark, sf):
    return monitor.coverage_curve(table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.concat_ws("|", "user_id", "event_type").alias("cell")))


QUERIES = {f.__name__: f for f in (tumbling_usage, sliding_usage, session_usage, deduplicated_events, running_means, monitor_alarms, span_conversations, coverage_curve)}

_SESSIONS = "x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)"
ORACLES = {
    "tumbling_usage": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "sliding_usage": "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, value FROM events), w AS (SELECT day - INTERVAL 1 DAY * k AS window_start, event_type, value FROM d, (SELECT unnest(range(7)) AS k)) SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2",
    "session_usage": f"WITH {_SESSIONS}, g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY user_id",
    "deduplicated_events": "SELECT event_type, count(DISTINCT event_id) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type",
    "running_means": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY event_type",
    "monitor_alarms": """WITH d AS (SELECT datediff('day', DATE '1990-01-01', ts::DATE) AS step, avg(value) AS proxy, avg((event_type = 'purchase')::INT::DOUBLE) AS gold, avg(length(props)) AS length FROM events GROUP BY ts::DATE),
        p AS (SELECT *, coalesce(lag(proxy, 3) OVER w, first_value(proxy) OVER w) AS p0, coalesce(lag(gold, 3) OVER w, first_value(gold) OVER w) AS g0, coalesce(lag(length, 3) OVER w, first_value(length) OVER w) AS l0 FROM d WINDOW w AS (ORDER BY step))
        SELECT step, round(proxy - p0, 6) AS proxy_gain, round(gold - g0, 6) AS gold_gain, proxy - p0 >= 0.02 AND gold <= g0 AS divergence, l0 > 0 AND length / l0 - 1 >= 0.25 AS length_alarm FROM p""",
    "span_conversations": "SELECT user_id, count(*) AS spans, count(*) FILTER (WHERE event_type = 'error') AS faults, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS first_kind, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last_kind, round(sum(value), 4) AS total_value FROM events GROUP BY user_id",
    "coverage_curve": "WITH f AS (SELECT user_id || '|' || event_type AS cell, min(strftime(ts, '%Y-%m-%d')) AS batch FROM events GROUP BY 1), n AS (SELECT batch, count(*) AS fresh FROM f GROUP BY batch), b AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS batch FROM events) SELECT b.batch, CAST(coalesce(fresh, 0) AS BIGINT) AS fresh, CAST(sum(coalesce(fresh, 0)) OVER (ORDER BY b.batch) AS BIGINT) AS covered FROM b LEFT JOIN n ON b.batch = n.batch",
}
