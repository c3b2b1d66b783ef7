"""Rules of states, statuses, retries, devices and days on inputs that tell the rules apart, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import devices as D
from ..operators import identity as I
from ..operators import quota as Q
from ..sources.views import NOW, TODAY, long_history, table, usage_fact
from .usage_queries import query

#: Messages and the code of each, by the rules of J31; the last two codes hold for one tool only.
MESSAGES = [
    ("EACCES: open cache manifest failed", "permission-denied"), ("No space left on device", "cache-write-failed"), ("could not write: Manifest persist FAILED", "cache-write-failed"),
    ("session token expired", "authentication-failed"), ("server said status 403", "authentication-failed"), ("connect ETIMEDOUT 10.0.0.1", "network-timeout"), ("the request timed out", "network-timeout"),
    ("lock timed out", None), ("expected CSV format", "invalid-response"), ("connection refused", "network-failed"), ("DNS lookup broke", "network-failed"), ("status code 4031", None), ("  ", None), (None, None),
    ("no running language server", "language-server-not-found"), ("RPC call: fail", "rpc-failed"),
]


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query(f"SELECT event_id, CASE WHEN k % 16 < 14 OR client = 'cursor' THEN [{', '.join(_text(c) for _, c in MESSAGES)}][k % 16 + 1] END AS code FROM fact", fact=True)
def error_classification(spark, d):
    message = F.get(F.array(*[F.lit(m) for m, _ in MESSAGES]), (F.col("k") % 16).cast("int"))
    tool = F.when(F.col("client") == "cursor", "antigravity").otherwise(F.col("client"))
    return usage_fact(spark, d).select("event_id", S.error_code(message, tool).alias("code"))


@query(
    "SELECT event_id, CASE WHEN k % 4 > 1 OR k // 4 % 7 > 4 THEN 'unknown' WHEN k // 4 % 7 = 4 THEN 'attention' WHEN k % 4 = 1 THEN 'unavailable' WHEN total % 2 = 1 THEN 'healthy' ELSE 'waiting' END AS state FROM fact", fact=True
)
def health_states(spark, d):
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    source = pick(["detected", "missing", "unknown", "odd"], F.col("k") % 4)
    collection = pick(["direct", "idle", "pending", "ok", "failed", "unknown", None], F.floor(F.col("k") / 4) % 7)
    return usage_fact(spark, d).select("event_id", S.overall_health(source, collection, F.col("total") % 2).alias("state"))


@query(
    """, b AS (SELECT event_id, CAST(event_id % 1000 AS DOUBLE) / 1000 AS part, least(300000, 5000 * pow(2, greatest(0, k % 12 - 1))) AS b, CASE WHEN event_type = 'error' THEN least(3600000, k * 100000) ELSE 0 END AS a FROM fact)
SELECT event_id, CAST(CASE WHEN a > 0 THEN ceil(a + part * least(5000, a * CAST(0.1 AS DOUBLE))) ELSE ceil(b / 2 + part * (b / 2)) END AS BIGINT) AS delay_ms FROM b""", fact=True
)
def retry_backoff(spark, d):
    asked = F.when(F.col("event_type") == "error", F.col("k") * 100_000).otherwise(0).cast("double")
    part = (F.col("event_id") % 1000).cast("double") / 1000
    return usage_fact(spark, d).select("event_id", S.backoff(F.col("k") % 12, part, asked).alias("delay_ms"))


@query(
    """WITH h AS (SELECT p_partkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name || chr(128512) || p_partkey, ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda h, c: ((h * 31 + CASE WHEN c > 65535 THEN (c >> 10) + 55232 ELSE c END + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM part)
SELECT p_partkey, CAST(abs(h) % 12 AS INTEGER) AS colour FROM h"""
)
def stable_colours(spark, d):
    name = F.concat("p_name", F.lit("\U0001f600"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", S.stable_colour(name).alias("colour"))


STATUSES = ["ok", "rateLimited", "sourceRateLimited", "unauthorized", "unavailable", "error", "odd"]


@query(
    f", r AS (SELECT user_id AS account, event_id AS device, ts AS updated_at, [{', '.join(map(_text, STATUSES))}][k % 7 + 1] AS status, k % 2 AS windows, [3, 2, 1, 1, 1, 1, 0][k % 7 + 1] AS rank FROM fact WHERE k % 7 > 0 OR user_id % 3 = 0) "
    "SELECT account, arg_max(device, (rank, windows, updated_at, device)) AS device, arg_max(status, (rank, windows, updated_at, device)) AS status FROM r GROUP BY account", fact=True
)
def quota_winner_statuses(spark, d):
    status = F.get(F.array(*[F.lit(x) for x in STATUSES]), (F.col("k") % 7).cast("int"))
    rows = usage_fact(spark, d).filter((F.col("k") % 7 > 0) | (F.col("user_id") % 3 == 0))
    rows = rows.select(F.col("user_id").alias("account"), F.col("event_id").alias("device"), F.col("ts").alias("updated_at"), status.alias("status"), (F.col("k") % 2).alias("windows"))
    return Q.winners(rows, ["account"], F.lit(False)).select("account", "device", "status")


BURN_RESETS_SQL = """, s AS (SELECT user_id, event_id AS seq, CAST(floor(epoch(ts)) AS DOUBLE) AS t, CAST(sum(total) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 100 AS DOUBLE) AS used, CAST(k % 3 AS VARCHAR) AS resets, CAST(k // 3 AS VARCHAR) AS seen, k FROM fact),
l AS (SELECT user_id, list(struct_pack(t := t, used := used, resets := resets, seen := seen, rate := CAST(0.0 AS DOUBLE)) ORDER BY t, seq) AS a FROM s WHERE k % 5 > 0 GROUP BY ALL),
r AS (SELECT user_id, list_reduce(a, lambda p, c: CASE WHEN c.seen = p.seen THEN p ELSE struct_pack(t := c.t, used := c.used, resets := c.resets, seen := c.seen, rate := CASE WHEN c.used < p.used OR c.resets <> p.resets OR c.t <= p.t THEN p.rate
  WHEN (c.used - p.used) / (c.t - p.t) >= p.rate THEN (c.used - p.used) / (c.t - p.t) ELSE CAST(0.3 AS DOUBLE) * ((c.used - p.used) / (c.t - p.t)) + CAST(0.7 AS DOUBLE) * p.rate END) END) AS z FROM l)"""


@query(f'{BURN_RESETS_SQL} SELECT user_id, z.t AS "at", z.used AS used, round(z.rate, 9) AS rate FROM r', fact=True)
def burn_rate_resets(spark, d):
    run = F.sum("total").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = usage_fact(spark, d).select("user_id", F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("seq"), (run % 100).alias("used"), F.when(F.col("k") % 5 == 0, "error").otherwise("ok").alias("status"), (F.col("k") % 3).alias("resets_at"), F.floor(F.col("k") / 3).alias("updated_at"))
    return Q.burn_rates(rows, ["user_id"]).withColumn("rate", F.round("rate", 9))


@query('SELECT c_custkey AS record, min(c_custkey) OVER (PARTITION BY c_custkey // 50) AS "group" FROM customer')
def identity_chains(spark, d):
    """Chains of fifty records, each of which shares a key with its neighbours only."""
    key = F.col("c_custkey")
    name = lambda x: F.concat_ws("-", F.floor(key / 50).cast("string"), F.floor(x / 3).cast("string"))
    return I.grouped_by_identity(table(spark, d, "customer").select(key.alias("record"), F.array(name(key), name(key + 1)).alias("keys")), "record", "keys")


def _stored(spark, d):
    """Customers as stored periods: some without an end, some that nobody dated."""
    key = F.col("c_custkey")
    now = F.lit(NOW).cast("timestamp")
    ago = lambda hours: F.timestamp_seconds(F.unix_timestamp(now) - hours * 3600)
    return table(spark, d, "customer").select(key.alias("device"), F.when(key % 3 == 0, ago(key % 7 - 3)).alias("ends_at"), F.when(key % 5 > 0, ago(key % 60)).alias("updated_at"), F.col("c_nationkey").alias("client"), F.round("c_acctbal", 2).alias("cost_usd"), (key % 11).alias("tokens"), F.when(key % 4 == 0, key % 6).alias("omitted"))


STORED_SQL = f"""st AS (SELECT c_custkey AS device, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR * (c_custkey % 7 - 3) END AS ends_at, CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR * (c_custkey % 60) END AS updated_at,
  c_nationkey AS client, c_acctbal, c_custkey % 11 AS tokens, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 6 END AS omitted FROM customer),
op AS (SELECT *, CASE WHEN ends_at IS NOT NULL THEN ends_at > TIMESTAMP '{NOW}' WHEN updated_at IS NULL THEN true ELSE CAST(updated_at AS DATE) = DATE '{TODAY}' END AS day_open,
  CASE WHEN ends_at IS NOT NULL THEN ends_at > TIMESTAMP '{NOW}' WHEN updated_at IS NULL THEN true ELSE date_trunc('month', updated_at) = date_trunc('month', DATE '{TODAY}') END AS month_open FROM st)"""


@query(f"WITH {STORED_SQL} SELECT device, day_open, month_open FROM op")
def period_expiry_rules(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return _stored(spark, d).select("device", *[D.is_open(now, F.col("ends_at"), F.col("updated_at"), p).alias(n) for p, n in (("today", "day_open"), ("month", "month_open"))])


@query(f"WITH {STORED_SQL} SELECT client, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(omitted), 0) AS BIGINT) AS omitted, count(*) AS devices FROM op WHERE day_open GROUP BY client")
def cross_device_aggregate(spark, d):
    return D.aggregate_devices(_stored(spark, d), F.lit(NOW).cast("timestamp"), "today", ["tokens"], ["client"], ["omitted"])


@query(f"WITH {STORED_SQL} SELECT device, CAST(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(updated_at) AS BIGINT) AS age_ms, coalesce(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(updated_at) > greatest(36000000, 2 * tokens * 3600000), false) AS stale FROM st")
def device_list(spark, d):
    rows = _stored(spark, d).withColumns({"received_at": F.lit(None).cast("timestamp"), "upload_ms": F.col("tokens") * 3_600_000})
    return D.device_list(rows, F.lit(NOW).cast("timestamp"), F.lit(36_000_000)).select("device", "age_ms", "stale")


@query("SELECT c_custkey AS device, c_name AS name FROM customer WHERE c_custkey % 10 <> 3")
def device_delete(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("device"), F.col("c_name").alias("name"))
    return D.delete_devices(rows, rows.filter("device % 10 = 3").select("device").unionByName(spark.createDataFrame([(-1,)], "device long")))


@query(
    f"""WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN DATE '2024-01-29' ELSE DATE '2024-01-30' END AS day, TIMESTAMP '{NOW}' - INTERVAL 1 HOUR * (c_custkey % 7 - 3) AS e, c_custkey % 3 AS z FROM customer)
SELECT c_custkey AS device, CASE WHEN day IS NULL OR (z = 2 AND e <= TIMESTAMP '{NOW}') THEN NULL WHEN e > TIMESTAMP '{NOW}' THEN day ELSE CAST(TIMESTAMP '{NOW}' + INTERVAL 1 HOUR * (9 * z) AS DATE) END AS current,
  CASE WHEN z = 2 AND e <= TIMESTAMP '{NOW}' THEN NULL ELSE day END AS snapshot FROM s"""
)
def device_day_state(spark, d):
    key, now = F.col("c_custkey"), F.lit(NOW).cast("timestamp")
    day = F.when(key % 4 == 0, "2024-02-30").when(key % 4 == 1, "2024-01-29").otherwise("2024-01-30")
    ends_at = F.timestamp_seconds(F.unix_timestamp(now) - (key % 7 - 3) * 3600)
    zone = F.when(key % 3 == 0, "UTC").when(key % 3 == 1, "Asia/Tokyo")
    return table(spark, d, "customer").select(key.alias("device"), S.day_state(day, ends_at, zone, now).alias("s")).select("device", "s.current", "s.snapshot")


@query(
    "SELECT event_id, CAST((k % 4 < 3) AS INT) + CAST((k // 4 % 4 < 3) AS INT) AS known, CASE WHEN k % 4 < 3 THEN ['active', 'waiting', 'missing'][k % 4 + 1] END AS claude, CASE WHEN k // 4 % 4 < 3 THEN ['active', 'waiting', 'missing'][k // 4 % 4 + 1] END AS codex FROM fact", fact=True
)
def client_states(spark, d):
    states = F.array(*[F.lit(x) for x in ("active", "waiting", "missing", "odd")])
    at = lambda x: F.get(states, x.cast("int"))
    found = S.known_states(F.create_map(F.lit("Claude Code"), at(F.col("k") % 4), F.lit("my codex"), at(F.floor(F.col("k") / 4) % 4), F.lit("!"), F.lit("active")))
    return usage_fact(spark, d).select("event_id", found.alias("s")).select("event_id", F.size("s").alias("known"), F.col("s")["claude"].alias("claude"), F.col("s")["codex"].alias("codex"))


@query(
    "SELECT s_suppkey, CAST(s_suppkey % 3 <> 0 AS INT) + CAST(s_suppkey % 2 AS INT) AS metered, CAST(s_suppkey % 3 <> 0 AS INT) AS weekly, s_suppkey % 5 = 0 OR s_suppkey % 5 = 1 AS balance_only FROM supplier"
)
def account_windows(spark, d):
    key = F.col("s_suppkey")
    metric = F.when(key % 5 == 0, "credits").when(key % 5 == 1, "spend").when(key % 5 == 2, "tokens")
    window = lambda kind, shown, left, metric: F.struct(F.lit(kind).alias("kind"), shown.alias("show_meter"), left.cast("double").alias("remaining_percent"), metric.alias("metric"))
    windows = F.array(window("weekly", F.lit(None).cast("boolean"), F.when(key % 3 != 0, key % 100), metric), window("session", key % 2 == 1, F.lit(5), F.lit("credits")), window("billing", F.lit(False), F.lit(1), F.lit("spend")))
    rows = table(spark, d, "supplier").select("s_suppkey", windows.alias("w"))
    return rows.select("s_suppkey", F.size(Q.metered_windows(F.col("w"))).alias("metered"), F.size(Q.metered_windows(F.col("w"), "weekly")).alias("weekly"), Q.is_balance_only(F.col("w")).alias("balance_only"))


@query("SELECT device, day, CAST(sum(tokens) AS BIGINT) AS tokens FROM hist WHERE day <= DATE '1996-06-30' AND day >= DATE '1996-06-30' - 40 GROUP BY ALL", hist=True)
def retention_prune(spark, d):
    kept = D.within_retention(long_history(spark, d), "day", F.lit("1996-06-30").cast("date"), 40)
    return kept.groupBy("device", "day").agg(F.sum("tokens").cast("long").alias("tokens"))


@query("SELECT project, CAST(row_number() OVER (ORDER BY sum(cost_nano) DESC, sum(total) DESC, project) AS INT) AS place FROM fact GROUP BY project", fact=True)
def project_order(spark, d):
    """Projects by cost, then tokens, then name (H2); there are as many rows as projects."""
    rows = usage_fact(spark, d).groupBy("project").agg(F.sum("cost_nano").alias("cost"), F.sum("total").alias("tokens"))
    return rows.select("project", F.row_number().over(Window.orderBy(F.col("cost").desc(), F.col("tokens").desc(), "project")).alias("place"))


@query("SELECT client, count(*) AS events FROM fact WHERE client IN ('claude', 'cursor', 'cursor-cli') GROUP BY client", fact=True)
def admitted_clients(spark, d):
    return usage_fact(spark, d).filter(F.col("client").isin(S.admitted_clients(" claude,cursor,, claude"))).groupBy("client").agg(F.count(F.lit(1)).alias("events"))


@query(
    """, o AS (SELECT day, client, model, max((total, k % 3)) AS o FROM fact WHERE k % 10 <> 7 AND (total > 0 OR k % 3 > 0) GROUP BY ALL), a AS (SELECT day, CAST(max(k % 2) AS BIGINT) AS active_ms FROM fact WHERE k % 10 <> 7 GROUP BY day)
SELECT a.day AS date, active_ms, count(o.day) AS observations, CAST(coalesce(sum(o.o[1]), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(o.o[2]), 0) AS BIGINT) AS messages FROM a LEFT JOIN o ON a.day = o.day GROUP BY ALL HAVING count(o.day) > 0 OR active_ms > 0""", fact=True
)
def normalized_days(spark, d):
    fact = usage_fact(spark, d)
    date = F.when(F.col("k") % 10 == 7, "2024-02-30").otherwise(F.concat(F.col("day").cast("string"), F.lit("T00:00")))
    rows = fact.select(date.alias("date"), F.upper("client").alias("client"), F.concat(F.lit(" "), "model").alias("model"), F.col("total").cast("string").alias("tokens"), (F.col("k") % 3).alias("messages"), F.lit("x").alias("cost_usd"), (F.col("k") % 2).alias("active_ms"))
    return D.normalized_days(rows).select("date", "active_ms", "observations", "tokens", "messages")


@query(
    """WITH i AS (SELECT c_custkey AS device, ['copilot', 'deepseek', 'claude'][c_custkey % 3 + 1] AS provider, CASE WHEN c_custkey % 2 = 0 THEN 'notConfigured' ELSE 'ok' END AS status, c_custkey % 5 AS app FROM customer),
o AS (SELECT c_custkey AS device, CASE WHEN c_custkey % 7 > 0 THEN 'key' END AS account_key, CASE WHEN c_custkey % 11 = 0 THEN 'disabled' ELSE 'ok' END AS status, c_custkey % 4 AS app FROM customer),
k AS (SELECT i.*, o.account_key, o.status AS old_status, provider <> 'claude' AND i.status = 'notConfigured' AND o.account_key IS NOT NULL AND o.status = 'ok' AND i.app <> o.app AND o.app > 0 AS keep FROM i JOIN o ON i.device = o.device)
SELECT device, provider, CASE WHEN keep THEN account_key END AS account_key, CASE WHEN keep THEN old_status ELSE status END AS status FROM k"""
)
def quota_merge_by_identity(spark, d):
    key = F.col("c_custkey")
    provider = F.get(F.array(F.lit("copilot"), F.lit("deepseek"), F.lit("claude")), (key % 3).cast("int"))
    customers = table(spark, d, "customer")
    row = lambda runtime, account, status: customers.select(key.alias("device"), runtime.alias("runtime"), provider.alias("provider"), account.alias("account_key"), F.lit("A@b.co").alias("email"), status.alias("status"))
    stored = row(F.when(key % 4 > 0, F.concat(F.lit("app "), (key % 4).cast("string"))), F.when(key % 7 > 0, F.lit("key")), F.when(key % 11 == 0, "disabled").otherwise("ok"))
    incoming = row(F.concat(F.lit("app "), (key % 5).cast("string")), F.lit(None).cast("string"), F.when(key % 2 == 0, "notConfigured").otherwise("ok"))
    return Q.merged_readings(stored, incoming).select("device", "provider", "account_key", "status")


@query(
    f"SELECT date, p50, peak FROM (SELECT day AS date, CAST(sum(total) AS BIGINT) AS p50, CAST(max(sum(total)) OVER () AS BIGINT) AS peak FROM fact WHERE day BETWEEN DATE '{TODAY}' - 13 AND DATE '{TODAY}' GROUP BY day)".replace("p50", "value"), fact=True
)
def sparkline(spark, d):
    """The last fourteen days' values and the largest of them (M2)."""
    rows = usage_fact(spark, d).filter(F.col("day").between(F.date_sub(F.lit(TODAY).cast("date"), 13), F.lit(TODAY).cast("date")))
    days = rows.groupBy(F.col("day").alias("date")).agg(F.sum("total").cast("long").alias("value"))
    return days.withColumn("peak", F.max("value").over(Window.partitionBy()))  # fourteen rows
