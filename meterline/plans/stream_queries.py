"""Streams run to their end over the events table. Closed windows only: rows still open at the watermark are not in append mode's result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import devices as D
from ..sources.views import CLIENTS, usage_fact
from ..streaming import streams as K
from .usage_queries import query


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def stream_daily_tumbling(spark, d):
    return K.run_to_end(K.daily_counts(K.event_stream(spark, d)), "complete")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 5 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT user_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM n GROUP BY user_id, id")
def stream_session_windows(spark, d):
    rows = K.run_to_end(K.session_windows(K.event_stream(spark, d)), "complete")
    return rows.select("user_id", "events", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(spark, d):
    events = K.event_stream(spark, d)
    return K.run_to_end(K.without_repeats(events, ["event_id"]).select("event_id", "event_type"), "append")


def burn_samples(spark, d):
    """Each user's events of a type as readings of a window. Files are in no order of time, so one batch takes all: a later one's older samples would be void."""
    events = K.event_stream(spark, d, max_files=None)
    return events.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("window"), F.unix_timestamp("ts").cast("double").alias("at"), F.col("event_id").alias("seq"), (F.floor(F.col("value") * 100 + 0.5) % 100).cast("double").alias("used"))


@query(
    """WITH l AS (SELECT user_id || '|' || event_type AS w, list(struct_pack(t := CAST(floor(epoch(ts)) AS DOUBLE), used := CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) % 100 AS DOUBLE), rate := CAST(0.0 AS DOUBLE)) ORDER BY floor(epoch(ts)), event_id) AS a FROM events GROUP BY ALL),
r AS (SELECT w, list_reduce(a, lambda p, c: struct_pack(t := c.t, used := c.used, rate := CASE WHEN c.used < p.used OR c.t <= p.t THEN p.rate WHEN (c.used - p.used) / (c.t - p.t) >= p.rate THEN (c.used - p.used) / (c.t - p.t) ELSE CAST(0.3 AS DOUBLE) * ((c.used - p.used) / (c.t - p.t)) + CAST(0.7 AS DOUBLE) * p.rate END)) AS z FROM l)
SELECT w AS "window", z.t AS "at", z.used AS used, round(z.rate, 9) AS rate FROM r"""
)
def stream_burn_state(spark, d):
    return K.run_to_end(K.burn_rates(burn_samples(spark, d)), "update", keys=["window"]).withColumn("rate", F.round("rate", 9))


@query("SELECT day, client, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL", fact=True)
def batch_daily_by_client(spark, d):
    return usage_fact(spark, d).groupBy("day", "client").agg(F.sum("total").cast("long").alias("total"))


@query(
    """, g AS (SELECT device, client, k, ts, event_id, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 MINUTE THEN 1 ELSE 0 END AS s FROM fact WINDOW w AS (PARTITION BY device ORDER BY ts, event_id)), n AS (SELECT *, sum(s) OVER (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS id FROM g)
SELECT device, strftime(max(ts) + INTERVAL 2 MINUTE, '%Y-%m-%d %H:%M:%S') AS due, CASE WHEN count(*) FILTER (WHERE k % 10 = 0) = 0 THEN string_agg(DISTINCT client, ',' ORDER BY client) END AS scope, count(*) AS changes FROM n GROUP BY device, id""", fact=True
)
def stream_scans(spark, d):
    """Changes of devices' tools as scans after two quiet minutes; a change in ten names no tool."""
    events = K.event_stream(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.create_map(*[F.lit(x) for pair in CLIENTS.items() for x in pair])
    changes = events.select("ts", F.concat(F.lit("dev-"), (F.col("user_id") % 4).cast("string")).alias("device"), F.when(k % 10 != 0, names[F.col("event_type")]).alias("client"))
    found = K.run_to_end(K.scans(changes, ["device"], "2 minutes"), "complete")
    return found.select("device", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"), F.when(F.col("scope").isNotNull(), F.concat_ws(",", "scope")).alias("scope"), "changes")


@query(
    """, t AS (SELECT device, day, CAST(floor(epoch(ts)) AS BIGINT) AS "at", bool_or(k % 3 = 0) AS changed FROM fact GROUP BY ALL),
x AS (SELECT *, min("at") OVER (PARTITION BY device, day ORDER BY "at" RANGE BETWEEN 3600 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t),
f AS (WITH RECURSIVE c AS (SELECT device, day, min("at") AS "at" FROM t GROUP BY ALL UNION ALL SELECT x.device, x.day, x.nxt FROM c JOIN x ON c.device = x.device AND c.day = x.day AND c."at" = x."at" WHERE x.nxt IS NOT NULL) SELECT * FROM c)
SELECT t.device, t.day, t."at" AS "at", CASE WHEN f."at" IS NOT NULL THEN 'full' WHEN changed THEN 'anchored' ELSE 'skip' END AS scan FROM t LEFT JOIN f ON t.device = f.device AND t.day = f.day AND t."at" = f."at" ORDER BY 1, 2, 3""", fact=True
)
def scan_plan(spark, d):
    ticks = usage_fact(spark, d).groupBy("device", "day", F.unix_timestamp("ts").alias("at")).agg(F.bool_or(F.col("k") % 3 == 0).alias("changed"))
    return D.scan_plan(ticks, ["device", "day"])
