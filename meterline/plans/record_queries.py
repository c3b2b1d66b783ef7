"""Records of devices brought to one shape and shown, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import money as M
from ..operators import records as N
from ..sources.views import NOW, table, usage_fact
from .account_queries import SUBS_SQL, _renewal_today, _subscriptions
from .usage_queries import query


def _pick(names, i):
    return F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))


@query(
    """SELECT event_id, client, CASE WHEN k % 5 > 0 THEN session ELSE 'f-' || event_id END AS session, CAST(total + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS total, CAST(k % 4 AS DOUBLE) AS cost,
  CASE WHEN k % 2 = 0 THEN ts END AS last_used_at, CAST(total + 1 AS BIGINT) AS model_tokens, k % 7 = 0 AS archived FROM fact WHERE k % 13 <> 1""", fact=True
)
def session_normalize(spark, d):
    k, as_text = F.col("k"), lambda c: F.col(c).cast("string")
    models = F.map_from_arrays(F.array(F.upper("model"), F.concat(F.lit(" "), "model"), F.lit(" ")), F.array(as_text("total"), F.lit("0.6"), F.lit("9")))
    sent = F.to_json(F.struct(
        F.when(k % 13 == 1, "Reasonix").when(k % 2 == 0, F.upper("client")).alias("client"), F.when(k % 2 == 1, F.col("client")).alias("agent"), F.when(k % 5 > 0, F.col("session")).alias("thread_id"),
        F.when(k % 3 == 0, F.col("total") + 1).alias("total_tokens"), F.col("input").alias("promptTokens"), F.col("output").alias("completion_tokens"), F.col("cache_read").alias("cacheRead"),
        as_text("cache_write").alias("cacheWriteTokens"), F.concat(F.lit("$"), (k % 4).cast("string")).alias("cost"), F.lit(7).alias("reasoning"), models.alias("models"),
        F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("updatedAt"), (k % 7 == 0).alias("sourceDeleted"), F.when(k % 7 == 1, F.lit("true")).alias("deleted"),
    ))
    rows = usage_fact(spark, d).select("event_id", "model", sent.alias("value"), F.concat(F.lit("f-"), as_text("event_id")).alias("fallback"))
    return N.normalized_sessions(rows).select("event_id", "client", "session", "total", "cost", "last_used_at", F.col("models")[F.col("model")].alias("model_tokens"), "archived")


@query(
    f"""SELECT c_custkey AS row, CASE WHEN c_custkey % 2 = 0 THEN 'd' || c_custkey WHEN c_custkey % 3 = 0 THEN 'i' || c_custkey ELSE 'unknown' END AS device, CASE WHEN c_custkey % 4 > 0 THEN 'os' END AS os_name, 'claude,codex' AS tracked,
  CASE c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS projects_enabled, CASE c_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'sent' END AS history, nullif(c_custkey % 4, 0) AS sessions_omitted_today,
  CASE c_custkey % 3 WHEN 0 THEN 600000 WHEN 1 THEN 0 END AS upload_ms, CASE WHEN c_custkey % 5 > 0 THEN '2024-01-30' END AS today_key, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 2 = 0 THEN 'Europe/Paris' END AS time_zone,
  CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-30 10:00:00' END AS updated_at FROM customer"""
)
def device_normalize(spark, d):
    key = F.col("c_custkey")
    part = lambda test, text: F.when(test, text).otherwise("")
    name = key.cast("string")
    sent = F.concat(
        F.lit("{"), part(key % 2 == 0, F.concat(F.lit('"deviceId":"d'), name, F.lit('",'))), part(key % 3 == 0, F.concat(F.lit('"id":"i'), name, F.lit('",'))), part(key % 4 > 0, F.lit('"osName":" os ",')),
        F.when(key % 2 == 0, '"trackedClients":["claude"," my Codex ","Claude Code",""],').otherwise('"trackedClients":"Claude,, codex ,claude",'),
        F.when(key % 3 == 0, '"projectsEnabled":false,"history":null,"syncUploadIntervalMs":600000,').when(key % 3 == 1, '"projectsEnabled":1,"history":{"days":[]},"syncUploadIntervalMs":5,').otherwise(""),
        part(key % 7 > 0, F.lit('"updatedAt":"2024-01-30T10:00:00Z",')), F.lit('"periodWindows":{"today":{"key":"2024-01-30","endsAt":"'), F.when(key % 5 > 0, "2024-01-31T00:00:00Z").otherwise("soon"),
        F.lit('"},"timeZone":"'), F.when(key % 2 == 0, "Europe/Paris").otherwise("Mars/Base"), F.lit('"},"sessionDetailsOmitted":{"today":'), (key % 4).cast("string"), F.lit("}}"),
    )
    out = N.normalized_devices(table(spark, d, "customer").select(key.alias("row"), sent.alias("value")), F.lit(NOW).cast("timestamp"))
    return out.select("row", "device", "os_name", F.concat_ws(",", "tracked").alias("tracked"), "projects_enabled", "history", "sessions_omitted_today", "upload_ms", "today_key", "time_zone", "updated_at")


@query(
    """SELECT s_suppkey AS row, ['claude', 'antigravity', 'nobody', 'deepseek'][s_suppkey % 4 + 1] AS provider, ['ok', 'error', 'rateLimited'][s_suppkey % 3 + 1] AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'api' ELSE '' END AS source,
  CASE WHEN s_suppkey % 4 = 1 THEN 'billing,weekly,session' ELSE 'session,weekly,billing' END || CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 > 0 THEN ',billing' ELSE '' END AS kinds,
  least(CAST(100 AS DOUBLE), CAST(s_suppkey % 50 AS DOUBLE) / 40 * 100) AS billing_percent, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 9 AS VARCHAR) || '.0,5.0' ELSE '' END AS grants, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Team ' || s_suppkey END AS account_label,
  CASE WHEN s_suppkey % 5 = 0 THEN 'user' || s_suppkey || '@mail.example' ELSE '' END AS email FROM supplier WHERE s_suppkey % 4 <> 2"""
)
def reading_normalize(spark, d):
    key = F.col("s_suppkey")
    text = lambda x: F.lit(x).cast("string")
    fields = ("kind", "type", "label", "used", "limit", "percent", "metric")
    window = lambda **w: F.struct(*[(w[f] if f in w and not isinstance(w[f], str) else text(w.get(f))).alias(f) for f in fields])
    windows = F.array(
        window(kind=" Billing_Cycle", label="Gemini #1", used=(key % 50).cast("string"), limit="$40"), window(type="Weekly", label="Claude x", percent="25%"), window(kind="five_hour"),
        window(kind="session", metric=F.when(key % 5 == 0, " Credits").otherwise("tokens")),
    )
    grant = lambda amount, at: F.struct(amount.alias("amount"), text(at).alias("expires_at"))
    balance = F.when(key % 3 == 0, F.struct(F.lit("$12.5").alias("amount"), F.lit("usd").alias("currency"), F.array(grant(F.lit("5"), None), grant((key % 9).cast("string"), "2024-02-01T00:00:00Z"), grant(text(None), None)).alias("tranches")))
    owner = F.when(key % 5 == 0, F.concat(F.lit("User"), key.cast("string"), F.lit("@Mail.example"))).otherwise(F.concat(F.lit("Team! "), key.cast("string")))
    sent = F.to_json(F.struct(_pick(["Claude ", "antigravity", "nobody", "DeepSeek"], key % 4).alias("provider"), _pick(["ok", "odd", "rateLimited"], key % 3).alias("status"), F.when(key % 2 == 0, "API").otherwise("post").alias("source"), windows.alias("windows"), balance.alias("balance"), owner.alias("accountLabel"), owner.alias("email")))
    out = N.normalized_readings(table(spark, d, "supplier").select(key.alias("row"), sent.alias("value")))
    billed = F.get(F.filter("windows", lambda w: (w["kind"] == "billing") & w["metric"].isNull()), F.lit(0))
    joined = lambda c, field: F.concat_ws(",", F.transform(c, lambda w: w[field].cast("string")))
    return out.select("row", "provider", "status", "source", joined("windows", "kind").alias("kinds"), billed["used_percent"].alias("billing_percent"), joined("tranches", "amount").alias("grants"), "account_label", "email")


@query(
    """, h AS (SELECT event_id, k, total, least(12, k % 5 * 4) AS checked, least(k % 7 * 3, least(12, k % 5 * 4)) AS detected, ['ok', 'failed', 'idle', 'unknown'][k % 4 + 1] AS collection, CASE WHEN k % 3 = 2 THEN CAST(total AS DOUBLE) ELSE 0 END AS live FROM fact),
o AS (SELECT *, CASE WHEN checked = 0 THEN 'unknown' WHEN detected > 0 THEN 'detected' ELSE 'missing' END AS source FROM h)
SELECT event_id, source, CAST(checked AS INTEGER) AS checked, CAST(detected AS INTEGER) AS detected, collection, concat_ws(',', CASE WHEN collection = 'failed' THEN 'sync-timeout' END, CASE WHEN source = 'missing' THEN 'source-missing' END, CASE WHEN source = 'detected' AND live = 0 THEN 'no-usage-observed' END, 'wsl-detected-no-data') AS diagnostics,
  CASE WHEN checked = 4 AND detected = 3 THEN 4 ELSE 0 END AS checks, CASE WHEN source = 'unknown' OR collection = 'unknown' THEN 'unknown' WHEN collection = 'failed' THEN 'attention' WHEN source = 'missing' THEN 'unavailable' WHEN live > 0 THEN 'healthy' ELSE 'waiting' END AS overall FROM o""", fact=True
)
def health_normalize(spark, d):
    k, ids = F.col("k"), ["claude-projects", "claude-transcripts", "codex-sessions", "pi-sessions"]
    checks = F.array(*[F.struct(F.lit(x).alias("id"), F.lit(i > 0).alias("exists")) for i, x in enumerate([*ids, "odd", ids[0]])])
    codes = F.array(*[F.struct(F.lit(x).alias("code")) for x in ("sync-timeout", "source-missing", " no-usage-observed", "sync-timeout", "odd", "wsl-detected-no-data")])
    live = F.when(k % 3 == 0, F.lit("x")).when(k % 3 == 2, F.col("total").cast("string"))
    sent = F.to_json(F.struct(F.struct((k % 5 * 4).alias("checkedCount"), (k % 7 * 3).alias("detectedCount"), checks.alias("checks")).alias("source"), F.struct(_pick(["ok", "failed", " idle ", "odd"], k % 4).alias("state")).alias("collection"), F.struct(live.alias("liveTokens")).alias("data"), codes.alias("diagnostics")))
    out = N.normalized_health(usage_fact(spark, d).select("event_id", sent.alias("value")), ids)
    return out.select("event_id", "source", "checked", "detected", "collection", F.concat_ws(",", "diagnostics").alias("diagnostics"), F.coalesce(F.array_size("checks"), F.lit(0)).alias("checks"), "overall")


@query(
    """, l AS (SELECT day, client AS name, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost, CAST(sum(cache_read) * 2 AS BIGINT) AS a, CAST(sum(cache_write) AS BIGINT) AS b, CAST(sum(output) AS BIGINT) AS c, CASE WHEN client = 'claude' AND day(day) % 3 = 0 THEN 5 END AS u, day(day) % 2 = 0 AS exact, count(*) FILTER (WHERE event_id % 2 = 0) AS messages FROM fact GROUP BY ALL),
r AS (SELECT *, bool_or(u IS NOT NULL) OVER (PARTITION BY day) AS said, least(a, tokens) AS cache_read FROM l), w AS (SELECT *, least(b, tokens - cache_read) AS cache_write FROM r), o AS (SELECT *, least(c, tokens - cache_read - cache_write) AS output FROM w)
SELECT day, name, tokens, cost, CAST(cache_read AS BIGINT) AS cache_read, CAST(cache_write AS BIGINT) AS cache_write, CAST(output AS BIGINT) AS output, CAST(CASE WHEN exact THEN 0 WHEN said THEN least(coalesce(u, 0), tokens - cache_read - cache_write - output) ELSE tokens - cache_read - cache_write - output END AS BIGINT) AS unclassified, exact, messages FROM o""", fact=True
)
def live_day_rows(spark, d):
    fact = usage_fact(spark, d)
    total = lambda c, n=1: (F.sum(c) * n).cast("long").alias(c)
    live = fact.groupBy("day", F.lit("client").alias("kind"), F.col("client").alias("name")).agg(total("total").alias("tokens"), total("cost_nano").alias("cost"), total("cache_read", 2), total("cache_write"), total("output"))
    live = live.withColumns({"unclassified": F.when((F.col("name") == "claude") & (F.dayofmonth("day") % 3 == 0), 5), "exact": F.dayofmonth("day") % 2 == 0})
    stored = fact.filter("event_id % 2 = 0").groupBy("day", F.lit("client").alias("kind"), F.col("client").alias("name")).agg(F.count(F.lit(1)).alias("messages"))
    names = ("cache_read", "cache_write", "output", "unclassified")
    return N.live_rows(live, stored).select("day", "name", "tokens", "cost", *[F.col(c).cast("long").alias(c) for c in names], "exact", "messages")


NATIVE_SQL = f"""e AS (SELECT user_id, arg_max(event_id, (CASE WHEN k % 3 > 0 THEN ts ELSE ts - INTERVAL 1 HOUR END, event_id)) AS event_id FROM fact GROUP BY user_id),
n AS (SELECT 's' || f.user_id AS session, total, project, CAST(ts - INTERVAL 1 HOUR * k AS DATE) AS made, CAST(CASE WHEN k % 2 = 1 THEN ts ELSE ts - INTERVAL 1 HOUR * k END AS DATE) AS active FROM fact f JOIN e ON f.event_id = e.event_id WHERE k % 9 > 0),
v AS (SELECT *, 'today' AS period, made = active AS reliable FROM n WHERE active = DATE '{NOW[:10]}' UNION ALL SELECT *, 'month', date_trunc('month', made) = date_trunc('month', active) FROM n WHERE date_trunc('month', active) = DATE '2024-01-01' UNION ALL SELECT *, 'all_time', true FROM n WHERE made >= DATE '2024-01-10')"""


def _native(spark, d):
    k, ts = F.col("k"), F.col("ts")
    ago = lambda hours: F.timestamp_micros(F.unix_micros(ts) - hours * 3_600_000_000)
    entries = usage_fact(spark, d).select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), F.col("event_id").alias("seq"), F.when(k % 9 > 0, ago(k)).alias("created_at"), F.when(k % 2 == 1, ts).alias("last_message_at"),
        F.when(k % 3 > 0, ts).alias("last_used_at"), ago(F.lit(1)).alias("started_at"), F.col("project").alias("project_label"), "total",
    )
    return N.native_view(entries, F.lit(NOW).cast("timestamp"), "UTC", F.lit("2024-01-10").cast("date"))


@query(f", {NATIVE_SQL} SELECT session, period, reliable, total FROM v", fact=True)
def native_session_view(spark, d):
    return _native(spark, d).select("session", "period", "reliable", "total")


@query(f", {NATIVE_SQL} SELECT period, lower(project) AS project, CAST(sum(greatest(0, total)) AS BIGINT) AS tokens, count(*) FILTER (WHERE total > 0) AS sessions FROM v WHERE reliable GROUP BY ALL", fact=True)
def native_project_view(spark, d):
    return N.native_projects(_native(spark, d))


@query(
    """WITH r AS (SELECT c_custkey AS row, c_custkey % 3 > 0 AS opencode, c_custkey % 2 = 0 AS local, ['local', 'web', 'api', NULL][c_custkey % 4 + 1] AS source, c_custkey % 5 = 0 AS managed, CAST(c_custkey % 7 < 3 AS INT) AS web, CAST(c_custkey % 7 IN (1, 3) AS INT) AS plain, CAST(c_custkey % 7 IN (2, 4) AS INT) AS own, c_custkey % 11 = 0 AS funds FROM customer),
m AS (SELECT *, web + plain + own AS n, web + CASE WHEN managed AND coalesce(source IN ('web', 'api'), false) THEN plain ELSE 0 END AS remote FROM r), t AS (SELECT *, opencode AND local AND (n > 0 OR funds) AS touched, remote > 0 OR funds AS stays FROM m),
c AS (SELECT *, touched AND NOT (stays AND remote = n AND coalesce(source IN ('web', 'api'), false)) AS changed FROM t)
SELECT row, CASE WHEN touched AND NOT stays THEN 'disabled' ELSE 'ok' END AS status, CASE WHEN changed AND stays THEN 'web' ELSE source END AS source, CASE WHEN changed AND stays THEN 'w' ELSE 'a' END AS account_key, CAST(CASE WHEN changed THEN remote ELSE n END AS INTEGER) AS windows FROM c"""
)
def displayed_limits(spark, d):
    key = F.col("c_custkey")
    window = lambda test, source: F.when(test, F.struct(F.lit("weekly").alias("kind"), F.lit(source).cast("string").alias("source")))
    windows = F.array_compact(F.array(window(key % 7 < 3, "web"), window((key % 7).isin(1, 3), None), window((key % 7).isin(2, 4), "local")))
    rows = table(spark, d, "customer").select(
        key.alias("row"), F.when(key % 3 > 0, "OpenCode").otherwise("claude").alias("provider"), (key % 2 == 0).alias("local"), _pick(["local", "web", "api", None], key % 4).alias("source"), F.when(key % 5 == 0, "managed").alias("source_detail"),
        F.lit("ok").alias("status"), F.lit(True).alias("stale"), F.lit("a").alias("account_key"), F.lit("w").alias("web_account_key"), windows.alias("windows"), F.when(key % 11 == 0, 3.0).alias("amount"), F.lit(None).cast("double").alias("balance_usd"),
    )
    return N.displayed_readings(rows).select("row", "status", "source", "account_key", F.size("windows").alias("windows"))


@query(f"""WITH {SUBS_SQL}, s AS (SELECT id, CASE WHEN id % 4 = 0 THEN DATE '2001-08-01' + CAST(id % 3 - 1 AS INTEGER) WHEN id % 4 = 1 THEN CAST(start + to_months(CAST(months AS INT)) AS DATE) END AS stop FROM sb) SELECT id, stop FROM s WHERE stop IS NULL OR stop > DATE '2001-08-01'""")
def active_subscriptions(spark, d):
    """Subscriptions that end on a day of their own, that run out, and that renew."""
    key = F.col("id")
    end = F.when(key % 4 == 0, F.date_add(_renewal_today(), (key % 3 - 1).cast("int")))
    rows = _subscriptions(spark, d).withColumn("stop", M.coverage_stop(end, key % 4 != 1, F.col("start"), F.col("months")))
    return rows.filter(M.is_active(F.col("stop"), _renewal_today())).select("id", "stop")
