"""Queries behind the screens: guards, preferences, captures, top lists, set operations, scrubbed and pruned rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import devices as D
from ..operators import export as X
from ..operators import history as H
from ..operators import identity as I
from ..operators import money as M
from ..operators import rollup as R
from ..operators import transcripts as T
from ..operators import views as V
from ..sources.views import NOW, TODAY, long_history, table, usage_fact
from .usage_queries import query


def _sum(rows, *keys, value="total"):
    return rows.groupBy(*keys).agg(F.sum(value).cast("long").alias("total"))


@query("SELECT client, CAST(sum(total) AS BIGINT) AS total FROM fact WHERE NOT (session LIKE '%@2024-01-0%') GROUP BY client", fact=True)
def synthetic_sessions_filter(spark, d):
    return _sum(V.without_synthetic(usage_fact(spark, d), "session", "@2024-01-0"), "client")


@query("SELECT device, bool_or(dur_ms > 190) AS participates FROM fact GROUP BY device", fact=True)
def participating_devices(spark, d):
    rows = usage_fact(spark, d).withColumn("v", F.when(F.col("dur_ms") > 190, 1).otherwise(0))
    return V.participates(rows, ["device"], ["v"])


@query("SELECT device, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY device HAVING (SELECT count(DISTINCT device) FROM fact) = 4", fact=True)
def availability_guard(spark, d):
    rows = _sum(usage_fact(spark, d), "device")
    return V.guarded(rows, rows, F.col("total") >= 0)


@query("SELECT client, CAST(sum(total) AS BIGINT) AS total, CASE client WHEN 'gemini' THEN 1 WHEN 'codex' THEN 1001 WHEN 'claude' THEN 1002 ELSE 1000000 END AS rank FROM fact WHERE client <> 'cursor' GROUP BY client", fact=True)
def display_preferences(spark, d):
    return V.preferred(_sum(usage_fact(spark, d), "client"), "client", ["gemini"], ["codex", "claude"], ["cursor"])


@query("SELECT user_id, CAST(min(CASE WHEN day >= DATE '2024-01-10' OR client = 'codex' THEN day END) AS VARCHAR) AS started_at, CAST(max(CASE WHEN day >= DATE '2024-01-10' OR client = 'codex' THEN day END) AS VARCHAR) AS last_used_at, max(project) AS project FROM fact GROUP BY user_id HAVING count_if(day >= DATE '2024-01-10') > 0", fact=True)
def session_metadata_join(spark, d):
    fact = usage_fact(spark, d)
    make = lambda rows: rows.groupBy("user_id").agg(F.min("day").alias("started_at"), F.max("day").alias("last_used_at"), F.max("project").alias("project"))
    rows = V.decorated(make(fact.filter("day >= date '2024-01-10'")), make(fact.filter("client = 'codex'")), ["user_id"])
    return rows.select("user_id", F.col("started_at").cast("string").alias("started_at"), F.col("last_used_at").cast("string").alias("last_used_at"), "project")


@query("SELECT client, model, CAST(sum(total) AS BIGINT) AS tokens, count(*) AS messages, CAST(greatest(0, sum(total) - coalesce(sum(total) FILTER (WHERE k % 2 = 0), 0)) AS BIGINT) AS unclassified FROM fact GROUP BY ALL", fact=True)
def live_day_metadata(spark, d):
    fact = usage_fact(spark, d)
    make = lambda rows: rows.groupBy("client", "model").agg(F.sum("total").cast("long").alias("tokens"), F.count(F.lit(1)).alias("messages"))
    return V.live_day(make(fact), make(fact.filter("k % 2 = 0")), ["client", "model"]).select("client", "model", "tokens", "messages", "unclassified")


@query("SELECT project, client, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL HAVING sum(total) > coalesce(sum(total) FILTER (WHERE k < 50 OR client = 'claude'), 0)", fact=True)
def attribution_check(spark, d):
    fact = usage_fact(spark, d)
    return V.missing_attribution(_sum(fact, "project", "client"), _sum(fact.filter("k < 50 or client = 'claude'"), "project", "client"), ["project", "client"], "total")


@query("SELECT client, CAST(sum(total) AS BIGINT) AS total, round(sum(total) / (SELECT sum(total) FROM fact), 9) AS share FROM fact GROUP BY client ORDER BY total DESC, client LIMIT 4", fact=True)
def top_tools(spark, d):
    return V.top_by(_sum(usage_fact(spark, d), "client"), "client", "total", 4)


@query("SELECT device, arg_min(client, (-c, client)) AS top FROM (SELECT device, client, CAST(sum(cost_nano) AS BIGINT) AS c FROM fact GROUP BY ALL) GROUP BY device", fact=True)
def top_tool_by_device(spark, d):
    rows = usage_fact(spark, d).groupBy("device", "client").agg(F.sum("cost_nano").cast("long").alias("cost"), F.sum("total").cast("long").alias("total"))
    return V.top_name(rows, ["device"], "client", "cost", "total")


@query("SELECT device, model, CAST(sum(total) AS BIGINT) AS total FROM fact WHERE exact GROUP BY ALL UNION ALL SELECT device, 'unknown', CAST(sum(total) AS BIGINT) FROM fact WHERE NOT exact GROUP BY device", fact=True)
def unknown_remainders(spark, d):
    fact = usage_fact(spark, d)
    return V.remainder_rows(_sum(fact.filter("exact"), "device", "model"), _sum(fact, "device"), ["device"], "model", "total")


@query(", s AS (SELECT day, client, model, CAST(sum(total) AS BIGINT) AS tokens FROM fact GROUP BY ALL) SELECT day, '[' || string_agg('{\"client\":\"' || client || '\",\"model\":\"' || model || '\",\"tokens\":' || tokens || '}', ',' ORDER BY client, model, tokens) || ']' AS clients FROM s GROUP BY day", fact=True)
def archive_to_graph(spark, d):
    rows = usage_fact(spark, d).groupBy("day", "client", "model").agg(F.sum("total").cast("long").alias("tokens"))
    return V.graph_json(rows)


@query("SELECT s AS event_type, (SELECT count(*) FROM events WHERE event_type = s) AS n FROM (VALUES ('view'), ('click'), ('nothing')) v(s)")
def state_counts(spark, d):
    return V.counts_of(table(spark, d, "events"), "event_type", ["view", "click", "nothing"])


@query(f"SELECT coalesce(max(day) FILTER (WHERE day BETWEEN DATE '2024-01-30' AND DATE '2024-01-31'), DATE '{TODAY}') AS today FROM fact", fact=True)
def aggregate_today(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return V.aggregate_today(usage_fact(spark, d), now, D.is_plausible_day(F.col("day"), now))


@query("SELECT c_nationkey AS id, CAST(greatest(0, arg_min(CAST(floor(c_acctbal) AS BIGINT), c_custkey)) AS BIGINT) AS amount, CAST(least(120, greatest(1, min(c_custkey) % 130)) AS BIGINT) AS months, 'USD' AS currency FROM customer GROUP BY c_nationkey")
def subscription_normalize(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.floor("c_acctbal").cast("long").alias("amount"), (F.col("c_custkey") % 130).alias("months"), F.lit(" ").alias("currency"), "c_custkey")
    return V.normalized_subscriptions(rows, ["c_custkey"]).select("id", F.col("amount").cast("long").alias("amount"), F.col("months").cast("long").alias("months"), "currency")


@query("SELECT event_id, client FROM fact ORDER BY ts DESC, client, event_id LIMIT 1", fact=True)
def latest_activity(spark, d):
    return V.latest_activity(usage_fact(spark, d)).select("event_id", "client")


@query("WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (WHERE value < 50))) AS a, list_sort(list_distinct(list(event_type) FILTER (WHERE value >= 50))) AS b FROM events GROUP BY user_id), t AS (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s) SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS all_types, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed FROM t")
def key_set_operations(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") >= 50, F.col("event_type"))).alias("b"))
    sets = V.key_sets(F.col("a"), F.col("b"))
    return rows.select("user_id", F.concat_ws(",", sets["union"]).alias("all_types"), F.concat_ws(",", sets["removed"]).alias("removed"))


@query("SELECT count(DISTINCT client || ':' || session) AS sessions FROM fact", fact=True)
def distinct_sessions(spark, d):
    return usage_fact(spark, d).agg(F.count_distinct("client", "session").alias("sessions"))


@query("WITH e AS (SELECT conv_id AS session, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS exchange, role, length(text) AS tokens FROM conversations WHERE role <> 'system'), x AS (SELECT session, exchange, CAST(coalesce(sum(tokens) FILTER (WHERE role <> 'user'), 0) AS BIGINT) AS tokens FROM e GROUP BY ALL) SELECT * FROM x ORDER BY tokens DESC, session, exchange LIMIT 25")
def exchange_order(spark, d):
    rows = table(spark, d, "conversations").filter("role <> 'system'").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "prompt").otherwise("turn").alias("kind"), F.length("text").cast("long").alias("tokens"))
    return T.exchanges(rows).select("session", "exchange", "tokens").orderBy(F.col("tokens").desc(), "session", "exchange").limit(25)


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ordinal, count(*) OVER (PARTITION BY c_nationkey) AS \"of\" FROM customer")
def account_ordinals(spark, d):
    return I.ordinals(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey").select("c_custkey", "c_nationkey", F.col("ordinal").cast("long").alias("ordinal"), "of")


@query("WITH k AS (SELECT c_mktsegment AS label, md5(CAST(c_custkey AS VARCHAR)) AS print FROM customer), p AS (SELECT label, print, substr(print, 1, n) AS prefix, count(*) OVER (PARTITION BY label, substr(print, 1, n)) AS c FROM k, range(2, 33) r(n)) SELECT label, print, arg_min(prefix, length(prefix)) AS prefix FROM p WHERE c = 1 GROUP BY ALL")
def shortest_unique_prefix(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("print"))
    return I.unique_prefix(rows, "label", "print", 2, 32)


@query("SELECT client, session, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL HAVING max(day) < DATE '2024-01-20'", fact=True)
def ended_session_capture(spark, d):
    rows = usage_fact(spark, d)
    ended = D.live_identity(rows, ["client", "session"], F.col("day") < F.lit("2024-01-20").cast("date")).select("client", "session")
    return _sum(rows.join(ended, ["client", "session"], "left_semi"), "client", "session")


@query("SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS topups, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total, CAST(coalesce(sum(floor(o_totalprice)) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '2001-07-01'), 0) AS BIGINT) AS this_month, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY o_custkey")
def topup_ledger(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), F.floor("o_totalprice").cast("long").alias("minor"))
    month = F.trunc("day", "month") == F.lit("2001-07-01").cast("date")
    return rows.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("topups"), F.sum("minor").cast("long").alias("total"), F.coalesce(F.sum(F.when(month, F.col("minor"))), F.lit(0)).cast("long").alias("this_month"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE)) AS start, CASE WHEN o_custkey % 3 = 0 THEN DATE '2000-01-01' WHEN o_custkey % 3 = 1 THEN CAST(min(CAST(o_orderdate AS DATE)) + INTERVAL 1 MONTH AS DATE) END AS stop FROM orders GROUP BY o_custkey")
def coverage_stops(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.to_date("o_orderdate")).alias("start"))
    end = F.when(F.col("id") % 3 == 0, F.lit("2000-01-01").cast("date"))
    return rows.select("id", "start", M.coverage_stop(end, F.col("id") % 3 == 2, F.col("start"), F.lit(1)).alias("stop"))


@query("SELECT day, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN day >= DATE '2001-07-03' THEN count(*) END AS messages FROM hist GROUP BY day", hist=True)
def transport_pruning(spark, d):
    days = H.daily(long_history(spark, d)).drop("cost_nano")
    return X.pruned(days, F.lit("2001-07-03").cast("date"), ["messages"])


@query("SELECT client, model, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY client, model, device", fact=True)
def public_projection(spark, d):
    return X.public(_sum(usage_fact(spark, d), "client", "model", "device"), ["device"])


@query("SELECT device, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY device ORDER BY device", fact=True)
def device_order(spark, d):
    return _sum(usage_fact(spark, d), "device").orderBy("device")


@query("SELECT user_id, client, CAST(sum(total) FILTER (WHERE day = DATE '2024-01-30') AS BIGINT) AS today, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY user_id, client", fact=True)
def turn_period_predicate(spark, d):
    rows = usage_fact(spark, d)
    today = F.col("day") == F.lit(TODAY).cast("date")
    return rows.groupBy("user_id", "client").agg(F.sum(F.when(today, F.col("total"))).cast("long").alias("today"), F.sum("total").cast("long").alias("total"))


@query(", s AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM hist GROUP BY ALL) SELECT month, model, tokens, round(tokens / sum(tokens) OVER (PARTITION BY month), 9) AS share FROM s", hist=True)
def legend_totals(spark, d):
    rows = long_history(spark, d).groupBy(F.trunc("day", "month").alias("month"), "model").agg(F.sum("tokens").cast("long").alias("tokens"))
    return rows.withColumn("share", F.round(R.share("tokens", "month"), 9))


@query("SELECT device, day, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(output) AS BIGINT) AS output, bool_and(exact) AS exact FROM fact WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY ALL", fact=True)
def selected_daily_merge(spark, d):
    rows = usage_fact(spark, d).filter(F.col("day").between("2024-01-24", TODAY))
    return rows.groupBy("device", "day").agg(F.sum("total").cast("long").alias("tokens"), F.sum("output").cast("long").alias("output"), F.bool_and("exact").alias("exact"))


@query("SELECT device, count(DISTINCT day) FILTER (WHERE day >= DATE '2024-01-24') AS week_days, count(DISTINCT day) AS all_days, CAST(coalesce(sum(total) FILTER (WHERE day = DATE '2024-01-30'), 0) AS BIGINT) AS today, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY device", fact=True)
def activity_stats(spark, d):
    day = F.col("day")
    return usage_fact(spark, d).groupBy("device").agg(F.count_distinct(F.when(day >= "2024-01-24", day)).alias("week_days"), F.count_distinct("day").alias("all_days"), F.coalesce(F.sum(F.when(day == TODAY, F.col("total"))), F.lit(0)).cast("long").alias("today"), F.sum("total").cast("long").alias("total"))


@query("SELECT section, name, value FROM (SELECT 'overview' AS section, 'tokens' AS name, CAST(sum(total) AS BIGINT) AS value FROM fact UNION ALL (SELECT 'models', model, CAST(sum(total) AS BIGINT) AS v FROM fact GROUP BY model ORDER BY v DESC, model LIMIT 3) UNION ALL SELECT 'trend', CAST(day AS VARCHAR), CAST(sum(total) AS BIGINT) FROM fact WHERE day >= DATE '2024-01-24' GROUP BY day)", fact=True)
def widget_snapshot(spark, d):
    fact = usage_fact(spark, d)
    part = lambda rows, section, name: rows.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col("total").alias("value"))
    overview = fact.agg(F.sum("total").cast("long").alias("total")).withColumn("n", F.lit("tokens"))
    models = _sum(fact, "model").orderBy(F.col("total").desc(), "model").limit(3)
    trend = _sum(fact.filter("day >= date '2024-01-24'"), "day")
    return part(overview, "overview", "n").unionByName(part(models, "models", "model")).unionByName(part(trend, "trend", "day"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'session' WHEN 1 THEN 'weekly' WHEN 2 THEN 'billing' WHEN 3 THEN 'billing' END AS kind, CAST(s_suppkey % 50 AS DOUBLE) AS used, 40.0::DOUBLE AS \"limit\", CASE WHEN s_suppkey % 2 = 0 THEN 7.5::DOUBLE END AS remaining, least(100.0, (s_suppkey % 50) / 40.0 * 100)::DOUBLE AS used_percent FROM supplier")
def quota_window_normalize(spark, d):
    from ..operators.quota import window_kind, window_numbers

    key = F.col("s_suppkey")
    numbers = window_numbers((key % 50).cast("string"), F.lit("$40"), F.when(key % 2 == 0, "7.5"), F.lit(None))
    kind = window_kind(F.when(key % 5 == 0, " Session").when(key % 5 == 1, "week-ly").when(key % 5 == 2, "Billing_Cycle").when(key % 5 == 3, "monthly").otherwise("five_hour"))
    return table(spark, d, "supplier").select("s_suppkey", kind.alias("kind"), *[numbers[c].alias(c) for c in ("used", "limit", "remaining", "used_percent")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'label ' || c_custkey ELSE '' END AS label FROM customer")
def account_labels(spark, d):
    from ..functions.scalars import account_label

    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" label  "), F.col("c_custkey").cast("string"), F.lit("!"))).otherwise(F.concat(F.lit("user@"), F.col("c_custkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", account_label(raw).alias("label"))


@query("SELECT p_partkey, lower(trim(p_name)) AS key FROM part")
def project_keys(spark, d):
    from ..functions.scalars import nfc_key

    return table(spark, d, "part").select("p_partkey", nfc_key(F.concat(F.lit(" "), F.upper("p_name"))).alias("key"))


@query("SELECT device, count(*) AS n, CAST(max(batch) AS BIGINT) AS batch FROM (SELECT DISTINCT device, client, model, 1 AS batch FROM fact) GROUP BY device", fact=True)
def client_capture(spark, d):
    rows = usage_fact(spark, d).select("device", "client", "model").distinct().withColumn("batch", F.lit(1))
    latest = D.latest(rows, ["device", "client", "model"], [F.col("batch")])
    return latest.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.max("batch").cast("long").alias("batch"))
