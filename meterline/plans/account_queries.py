"""Prices, devices, archives, transcripts, quotas, money, exports and sources over the test tables, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import devices as D
from ..operators import export as X
from ..operators import identity as I
from ..operators import money as M
from ..operators import quota as Q
from ..operators import rollup as R
from ..operators import transcripts as T
from ..sources.views import NOW, TODAY, long_history, table, usage_fact
from .usage_queries import ORACLE_SQL, PERIODS, QUERIES, query


def _now():
    return F.lit(NOW).cast("timestamp")


# Prices and currency

PRICES_SQL = """
pr AS (SELECT 'vendor' || (p_partkey % 3) || '/' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-' || p_partkey END AS model_key, CASE WHEN p_partkey % 2 = 0 THEN CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) ELSE p_size END AS rate FROM part),
prices AS (SELECT model_key, min(rate) AS rate FROM pr GROUP BY model_key)
"""


def _prices(spark, d):
    part = table(spark, d, "part")
    odd = F.col("p_partkey") % 2 != 0
    key = F.concat(F.lit("vendor"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.col("p_brand"), F.when(odd, F.concat(F.lit("-"), F.col("p_partkey").cast("string"))).otherwise(""))
    rate = F.when(odd, F.col("p_size").cast("long")).otherwise(F.regexp_replace("p_brand", "[^0-9]", "").cast("long"))
    rows = part.select(key.alias("model_key"), rate.alias("rate"), F.lit("2024-01-01").cast("timestamp").alias("dated"))
    rows = rows.withColumns({r: F.col("rate").cast("double") for r in M.RATES}).withColumn("priority", F.col("rate"))
    return M.catalog(rows, _now())


def _lines(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("tokens"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


@query(f"WITH {PRICES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) * rate AS DOUBLE) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN prices ON model_key = 'vendor' || (p_partkey % 3) || '/' || p_brand || '-' || p_partkey")
def priced_rows(spark, d):
    key = F.concat(F.lit("vendor"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string"))
    rows = M.priced(_lines(spark, d).withColumn("model", key), _prices(spark, d))
    cost = M.row_cost({"input_rate": F.col("tokens"), "read_rate": F.lit(0)}, F.col("rates"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", cost.alias("cost"))


@query(f"WITH {PRICES_SQL}, t AS (SELECT string_split(model_key, '/')[-1] AS seg, min(rate) AS rate FROM prices GROUP BY seg HAVING count(DISTINCT rate) = 1) SELECT p_brand, count(*) AS n, max(CAST(rate AS DOUBLE)) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN t ON seg = p_brand GROUP BY p_brand")
def pricing_terminal_fallback(spark, d):
    rows = M.priced(_lines(spark, d).withColumn("model", F.col("p_brand")), _prices(spark, d))
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("rates.input_rate").alias("rate"))


@query("SELECT client, currency, CAST(sum(total) AS BIGINT) AS total, round(CAST(CAST(sum(total) AS BIGINT) AS DOUBLE) * rate, 6) AS converted FROM fact, (VALUES ('USD', 1.0), ('EUR', 0.5), ('CNY', 7.25)) r(currency, rate) GROUP BY client, currency, rate", fact=True)
def currency_convert(spark, d):
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 0.5), ("CNY", 7.25)], "currency string, rate double")
    sums = usage_fact(spark, d).groupBy("client").agg(F.sum("total").cast("long").alias("total"))
    return sums.crossJoin(F.broadcast(rates)).select("client", "currency", "total", S.convert_usd(F.col("total").cast("double"), F.col("rate")).alias("converted"))  # three rates


# Devices

DEVICE_SQL = "dv AS (SELECT device, max(ts) - INTERVAL 1 DAY * CAST(right(device, 1) AS INT) AS updated_at, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY device)"


def _devices(spark, d):
    rows = usage_fact(spark, d).groupBy("device").agg(F.max("ts").alias("last"), F.sum("total").cast("long").alias("total"))
    return rows.select("device", F.expr("last - make_dt_interval(cast(right(device, 1) as int), 0, 0, 0)").alias("updated_at"), "total")


@query(f", {DEVICE_SQL} SELECT device, CAST(updated_at AS DATE) = DATE '{TODAY}' AS today_open, date_trunc('month', updated_at) = DATE '2024-01-01' AS month_open, TIMESTAMP '{NOW}' - updated_at > INTERVAL 36 HOUR AS stale FROM dv", fact=True)
def device_expiry(spark, d):
    none = F.lit(None).cast("timestamp")
    flags = {"today_open": D.is_open(_now(), none, F.col("updated_at"), "today"), "month_open": D.is_open(_now(), none, F.col("updated_at"), "month"), "stale": D.is_stale(_now(), F.col("updated_at"), F.lit(36 * 3600 * 1000), F.lit(1000))}
    return _devices(spark, d).select("device", *[c.alias(n) for n, c in flags.items()])


@query("SELECT c_custkey % 50 AS device, arg_max(c_name, c_custkey) AS name, CASE WHEN (max(c_custkey) // 50) % 2 = 0 THEN arg_max(c_mktsegment, c_custkey) ELSE 'old' END AS history FROM customer GROUP BY ALL")
def device_upsert_carry(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("device"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("history"), "c_custkey")
    new = D.latest(rows, ["device"], [F.col("c_custkey")]).withColumn("has_history", F.floor(F.col("c_custkey") / 50) % 2 == 0)
    old = rows.select("device").distinct().select("device", F.lit("older").alias("name"), F.lit("old").alias("history"))
    return D.upsert(old, new, "device", ["history"])


@query(", t AS (SELECT device, client, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL), n AS (SELECT device, client, CAST(sum(total) AS BIGINT) AS total FROM fact WHERE client IN ('claude', 'codex') AND k % 2 = 0 GROUP BY ALL) SELECT * FROM n UNION ALL SELECT t.* FROM t ANTI JOIN n ON t.device = n.device AND t.client = n.client WHERE t.client NOT IN ('claude', 'codex')", fact=True)
def untracked_carry(spark, d):
    sums = lambda rows: rows.groupBy("device", "client").agg(F.sum("total").cast("long").alias("total"))
    fact, tracked = usage_fact(spark, d), F.col("client").isin("claude", "codex")
    return D.carry_missing(sums(fact), sums(fact.filter(tracked & (F.col("k") % 2 == 0))), ["device", "client"], tracked)


@query("SELECT client, model, CAST(sum(total) AS BIGINT) AS total, CAST(sum(output) AS BIGINT) AS output FROM fact GROUP BY ALL", fact=True)
def today_delta(spark, d):
    fact = usage_fact(spark, d)
    sums = lambda rows: rows.groupBy("client", "model").agg(F.sum("total").cast("long").alias("total"), F.sum("output").cast("long").alias("output"))
    today, anchored = F.col("day") == F.lit(TODAY).cast("date"), F.col("ts") < F.lit(f"{TODAY} 09:00:00").cast("timestamp")
    base, anchor, fresh = sums(fact.filter(~today | anchored)), sums(fact.filter(today & anchored)), sums(fact.filter(today))
    return D.apply_delta(base, fresh, anchor, ["client", "model"], ["total", "output"])


@query("SELECT client, day, CAST(sum(CASE WHEN client = 'codex' THEN 2 * total ELSE total END) AS BIGINT) AS total FROM fact GROUP BY ALL", fact=True)
def targeted_partition_replace(spark, d):
    rows = usage_fact(spark, d).groupBy("client", "day").agg(F.sum("total").cast("long").alias("total"))
    return D.replace_partitions(rows, rows.withColumn("total", 2 * F.col("total")), ["client", "day"], F.col("client") == "codex")


@query("SELECT device, CASE WHEN device = 'dev-1' THEN 'local' ELSE 'hub' END AS origin, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL", fact=True)
def local_wins_overlay(spark, d):
    rows = usage_fact(spark, d).groupBy("device").agg(F.sum("total").cast("long").alias("total"))
    return D.merge_rows(rows.filter("device = 'dev-1'").withColumn("origin", F.lit("local")), rows.withColumn("origin", F.lit("hub")), "device").select("device", "origin", "total")


# Archives

@query("SELECT day, client, model, arg_max(tokens, (tokens, messages, batch)) AS tokens, arg_max(batch, (tokens, messages, batch)) AS batch FROM (SELECT day, client, model, device AS batch, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS messages FROM hist GROUP BY ALL) GROUP BY ALL", hist=True)
def archive_monotone_max(spark, d):
    seen = long_history(spark, d).groupBy("day", "client", "model", F.col("device").alias("batch")).agg(F.sum("tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("messages"))
    return D.archive(seen, ["day", "client", "model"]).select("day", "client", "model", "tokens", "batch")


@query(", s AS (SELECT client, session, max(day) AS last, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL) SELECT client, session, total, last < DATE '2024-01-15' AS archived FROM s WHERE last >= DATE '2024-01-15' OR client <> 'cursor'", fact=True)
def archive_sessions_antijoin(spark, d):
    rows = usage_fact(spark, d).groupBy("client", "session").agg(F.max("day").alias("last"), F.sum("total").cast("long").alias("total"))
    old = F.col("last") < F.lit("2024-01-15").cast("date")
    live = rows.filter(~old).withColumn("archived", F.lit(False))
    stored = rows.filter("client <> 'cursor'").withColumn("archived", F.lit(True))
    return D.carry_missing(stored, live, ["client", "session"], F.lit(False)).select("client", "session", "total", "archived")


@query(", s AS (SELECT client, device, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL) SELECT client, device, total, client NOT IN ('claude', 'gemini') AS archived FROM s", fact=True)
def archive_clients_antijoin(spark, d):
    rows = usage_fact(spark, d).groupBy("client", "device").agg(F.sum("total").cast("long").alias("total"))
    active = F.col("client").isin("claude", "gemini")
    return D.carry_missing(rows.withColumn("archived", F.lit(True)), rows.filter(active).withColumn("archived", F.lit(False)), ["client", "device"], active)


# Transcripts

def _events(spark, d):
    rows = table(spark, d, "conversations").filter("role <> 'system'")
    return rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "prompt").otherwise("turn").alias("kind"), F.length("text").cast("long").alias("tokens"))


EVENTS_SQL = "e AS (SELECT conv_id AS session, turn AS seq, role = 'user' AS prompt, length(text) AS tokens, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS exchange FROM conversations WHERE role <> 'system')"


@query(f"WITH {EVENTS_SQL} SELECT session, exchange, count_if(NOT prompt) AS turns, CAST(coalesce(sum(tokens) FILTER (WHERE NOT prompt), 0) AS BIGINT) AS tokens, min(seq) AS first_seq FROM e GROUP BY ALL")
def exchanges(spark, d):
    return T.exchanges(_events(spark, d))


@query(f"WITH {EVENTS_SQL}, x AS (SELECT session, exchange, CAST(coalesce(sum(tokens) FILTER (WHERE NOT prompt), 0) AS BIGINT) AS tokens FROM e GROUP BY ALL) SELECT session, exchange, tokens, round(CASE WHEN sum(tokens) OVER (PARTITION BY session) > 0 THEN 2.0 * tokens / sum(tokens) OVER (PARTITION BY session) ELSE 0 END, 9) AS cost FROM x")
def exchange_cost_allocation(spark, d):
    rows = T.allocate(T.exchanges(_events(spark, d)).withColumn("cost", F.lit(2.0)), "cost", "tokens")
    return rows.select("session", "exchange", "tokens", F.round("allocated", 9).alias("cost"))


@query(", s AS (SELECT client, session, CAST(sum(total) AS BIGINT) AS total, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, max(ts) AS last FROM fact GROUP BY ALL) SELECT client, session, total, cost_nano FROM s QUALIFY row_number() OVER (ORDER BY last DESC, total DESC, cost_nano DESC, client, session) <= 20", fact=True)
def session_order_topk(spark, d):
    return T.session_order(R.sessions(usage_fact(spark, d)), 20).select("client", "session", "total", "cost_nano")


@query(", b AS (SELECT user_id, k, arg_max(event_id, (total, ts, event_id)) AS chunk_id, max(total) AS total, max(ts) AS t FROM fact GROUP BY ALL) SELECT user_id, k, chunk_id, total, strftime(t, '%Y-%m-%d %H:%M:%S') AS \"at\" FROM b", fact=True)
def chunk_dedup(spark, d):
    chunks = usage_fact(spark, d).select("user_id", "k", F.col("event_id").alias("chunk_id"), "total", F.col("ts").alias("at"))
    return T.best_chunk(chunks, ["user_id", "k"], "total", "at").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


# Quotas

READINGS_SQL = "rd AS (SELECT user_id % 20 AS account, device, max(ts) AS updated_at, count(DISTINCT client) AS windows, CASE WHEN max(k) % 2 = 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN min(k) % 2 = 0 THEN max(total) END AS balance FROM fact GROUP BY ALL)"


def _readings(spark, d):
    rows = usage_fact(spark, d).groupBy((F.col("user_id") % 20).alias("account"), "device")
    return rows.agg(F.max("ts").alias("updated_at"), F.count_distinct("client").alias("windows"), F.when(F.max("k") % 2 == 0, "ok").otherwise("error").alias("status"), F.when(F.min("k") % 2 == 0, F.max("total")).alias("balance"))


def _stale():
    return F.col("updated_at") < F.lit("2024-01-30 00:00:00").cast("timestamp")


@query(f", {READINGS_SQL}, w AS (SELECT account, arg_max(device, (updated_at >= TIMESTAMP '2024-01-30', CASE status WHEN 'ok' THEN 4 ELSE 2 END, windows, updated_at, device)) AS device FROM rd GROUP BY account) SELECT w.account, w.device, status, windows FROM w JOIN rd ON w.account = rd.account AND w.device = rd.device", fact=True)
def quota_winner(spark, d):
    return Q.winners(_readings(spark, d), ["account"], _stale()).select("account", "device", "status", "windows")


@query(f", {READINGS_SQL} SELECT account, arg_max(balance, (updated_at, device)) AS balance FROM rd WHERE updated_at >= TIMESTAMP '2024-01-30' AND balance IS NOT NULL GROUP BY account", fact=True)
def quota_balance_carry(spark, d):
    return Q.carried_balance(_readings(spark, d), ["account"], _stale())


WINDOWS_SQL = "wn AS (SELECT user_id % 20 AS account, client AS kind, arg_max(total % 101, (ts, event_id)) AS used, max((ts, event_id)) AS o FROM fact GROUP BY ALL)"


def _windows(spark, d):
    rows = usage_fact(spark, d).select((F.col("user_id") % 20).alias("account"), F.col("client").alias("kind"), F.col("ts").alias("updated_at"), F.col("event_id").alias("device"), (F.col("total") % 101).alias("used"))
    return Q.merged_windows(rows, ["account", "kind"])


@query(f", {WINDOWS_SQL} SELECT account, kind, used, CAST(100 - least(used, 100) AS DOUBLE) AS remaining_percent FROM wn", fact=True)
def quota_component_merge(spark, d):
    numbers = Q.window_numbers(F.col("used"), F.lit(100), F.lit(None), F.concat(F.col("used").cast("string"), F.lit("%")))
    return _windows(spark, d).select("account", "kind", "used", numbers["remaining_percent"].alias("remaining_percent"))


@query(f", {WINDOWS_SQL}, r AS (SELECT account, kind, 100 - least(used, 100) AS remaining_percent FROM wn), f AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY remaining_percent, kind) AS n FROM r) SELECT account, CAST(min(remaining_percent) AS BIGINT) AS least, string_agg(kind, ',' ORDER BY n) AS kinds FROM f WHERE n <= 2 GROUP BY account ORDER BY least, account LIMIT 5", fact=True)
def quota_worst(spark, d):
    rows = _windows(spark, d).withColumn("remaining_percent", 100 - F.least("used", F.lit(100)))
    return Q.tightest(rows, ["account"], 5)


def _samples(spark, d):
    over = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = usage_fact(spark, d).withColumn("run", F.sum("total").over(over))
    return rows.select("user_id", "event_type", F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("run") % 100).alias("used"))


BURN_SQL = """, s AS (SELECT user_id, event_type, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(sum(total) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) % 100 AS used FROM fact),
l AS (SELECT user_id, event_type, list(struct_pack(t := CAST(t AS DOUBLE), used := CAST(used AS DOUBLE), rate := CAST(0.0 AS DOUBLE)) ORDER BY t, seq) AS a FROM s GROUP BY ALL),
r AS (SELECT user_id, event_type, list_reduce(a, lambda p, c: struct_pack(t := c.t, used := c.used, rate := CASE WHEN c.used < p.used OR c.t <= p.t THEN p.rate WHEN (c.used - p.used) / (c.t - p.t) >= p.rate THEN (c.used - p.used) / (c.t - p.t) ELSE CAST(0.3 AS DOUBLE) * ((c.used - p.used) / (c.t - p.t)) + CAST(0.7 AS DOUBLE) * p.rate END)) AS z FROM l)"""


@query(f"{BURN_SQL} SELECT user_id, event_type, z.t AS \"at\", z.used AS used, round(z.rate, 9) AS rate FROM r", fact=True)
def burn_rate_ema(spark, d):
    return Q.burn_rates(_samples(spark, d), ["user_id", "event_type"]).withColumn("rate", F.round("rate", 9))


@query(f"{BURN_SQL} SELECT user_id, event_type, round(greatest(1706616000.0, z.t + greatest(60.0, (100 - z.used) / z.rate / 4)), 3) AS due FROM r WHERE z.rate > 0 AND z.used < 100", fact=True)
def urgency_schedule(spark, d):
    return Q.urgency(Q.burn_rates(_samples(spark, d), ["user_id", "event_type"]), 1706616000.0).select("user_id", "event_type", F.round("due", 3).alias("due"))


@query(f"SELECT strftime(min(ts + INTERVAL 5 HOUR + INTERVAL 30 SECOND), '%Y-%m-%d %H:%M:%S') AS due FROM events WHERE ts + INTERVAL 5 HOUR + INTERVAL 30 SECOND > TIMESTAMP '{NOW}'")
def reset_boundary(spark, d):
    rows = table(spark, d, "events").select((F.col("ts").cast("timestamp") + F.expr("INTERVAL 5 HOURS")).alias("resets_at"))
    return Q.next_reset(rows, _now()).select(F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query(f"SELECT CAST(coalesce(sum(total) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 5 HOUR), 0) AS BIGINT) AS session, CAST(coalesce(sum(total) FILTER (WHERE ts >= TIMESTAMP '2024-01-29'), 0) AS BIGINT) AS weekly, CAST(coalesce(sum(total) FILTER (WHERE ts >= TIMESTAMP '2024-01-17'), 0) AS BIGINT) AS billing FROM fact WHERE ts < TIMESTAMP '{NOW}'", fact=True)
def range_sum_windows(spark, d):
    sums = Q.window_sums(usage_fact(spark, d), _now(), F.lit("2023-11-17 08:30:00").cast("timestamp"), "total")
    return sums.select(*[F.col(c).cast("long").alias(c) for c in ("session", "weekly", "billing")])


@query("SELECT event_id, lag(total) OVER (PARTITION BY user_id, client ORDER BY ts, event_id) AS previous_total FROM fact", fact=True)
def previous_samples(spark, d):
    return Q.with_previous(usage_fact(spark, d), ["user_id", "client"], ["ts", "event_id"], ["total"]).select("event_id", "previous_total")


@query("SELECT event_id, CASE WHEN date_diff('microsecond', a.at, ts) <= 600000000 - 1 + 1000000 AND epoch(date_trunc('second', ts)) - epoch(date_trunc('second', a.at)) <= 600 THEN a.v END AS last_good FROM (SELECT event_id, ts, last_value(CASE WHEN k % 4 <> 0 THEN {'at': ts, 'v': total} END IGNORE NULLS) OVER (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a FROM fact)", fact=True)
def last_good_retention(spark, d):
    rows = Q.keep_last_good(usage_fact(spark, d), ["client"], F.col("k") % 4 != 0, ["ts", "event_id"], "total", 600)
    return rows.select("event_id", "last_good")


# Money

@query(", s AS (SELECT user_id, day, greatest(0, coalesce(lag(50000 - total) OVER (PARTITION BY user_id ORDER BY ts, event_id) - (50000 - total), 0)) AS spent FROM fact) SELECT user_id, day, CAST(sum(spent) AS BIGINT) AS spent FROM s GROUP BY ALL", fact=True)
def balance_spend(spark, d):
    rows = usage_fact(spark, d).withColumn("paid", 50000 - F.col("total"))
    return M.spending(rows, "user_id", "paid", ("ts", "event_id")).groupBy("user_id", "day").agg(F.sum("spent").cast("long").alias("spent"))


SUBS_SQL = "sb AS (SELECT c_custkey AS id, min(CAST(o_orderdate AS DATE)) AS start, CAST(min(floor(o_totalprice)) AS BIGINT) AS amount, CASE WHEN c_custkey % 3 = 0 THEN 12 ELSE 1 END AS months FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey)"


def _subscriptions(spark, d):
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.to_date("o_orderdate")).alias("start"), F.floor(F.min("o_totalprice")).cast("long").alias("amount"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return first.join(known, "id").withColumn("months", F.when(F.col("id") % 3 == 0, 12).otherwise(1))


def _renewal_today():
    return F.lit("2001-08-01").cast("date")


@query(f"WITH {SUBS_SQL} SELECT id, (SELECT min(CAST(start + to_months(CAST(k * months AS INT)) AS DATE)) FROM range(0, 120) r(k) WHERE start + to_months(CAST(k * months AS INT)) >= DATE '2001-08-01') AS renewal FROM sb")
def renewals(spark, d):
    return _subscriptions(spark, d).select("id", M.next_renewal(F.col("start"), F.col("months"), _renewal_today()).alias("renewal"))


@query(f"WITH {SUBS_SQL} SELECT id, CAST(amount * (SELECT count(*) FROM range(0, 120) r(k) WHERE start + to_months(CAST(k * months AS INT)) <= DATE '2001-08-01') AS BIGINT) AS paid FROM sb")
def paid_to_date(spark, d):
    return _subscriptions(spark, d).select("id", (F.col("amount") * M.elapsed_charges(F.col("start"), F.col("months"), _renewal_today())).cast("long").alias("paid"))


@query(f"WITH {SUBS_SQL} SELECT CAST(sum(CAST(floor(amount / months + 0.5) AS BIGINT)) AS BIGINT) AS monthly, count(*) AS plans FROM sb")
def monthly_subscription_total(spark, d):
    return _subscriptions(spark, d).agg(F.sum(M.monthly_minor(F.col("amount"), F.col("months"))).cast("long").alias("monthly"), F.count(F.lit(1)).alias("plans"))


@query(f"WITH {SUBS_SQL} SELECT id, CASE WHEN amount > amount // 3 THEN DATE '2001-08-01' + CAST(floor((amount // 3) / ((amount - amount // 3) / greatest(1, date_diff('day', start, DATE '2001-08-01')))) AS INT) END AS ends FROM sb")
def topup_projection(spark, d):
    rows = _subscriptions(spark, d).withColumn("remaining", F.floor(F.col("amount") / 3).cast("long"))
    return rows.select("id", M.exhaustion(F.col("amount"), F.col("remaining"), F.col("start"), _renewal_today()).alias("ends"))


@query("WITH a AS (SELECT n_nationkey AS provider, s_suppkey AS account_key, s_name AS profile, count(*) OVER (PARTITION BY s_nationkey) AS m, count(*) OVER (PARTITION BY s_nationkey, s_name) AS np FROM supplier JOIN nation ON s_nationkey = n_nationkey), s AS (SELECT c_custkey AS id, c_nationkey AS provider, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 100 END AS bound_key, CASE WHEN c_custkey % 4 = 1 THEN 'Supplier#' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0') END AS profile FROM customer), x AS (SELECT s.id, a.account_key, CASE WHEN s.bound_key = a.account_key THEN 1 WHEN s.profile = a.profile AND np = 1 THEN 3 WHEN m = 1 THEN 4 END AS rank FROM s LEFT JOIN a ON s.provider = a.provider) SELECT id, CAST(min(rank) AS INT) AS rank, CASE WHEN min(rank) IS NOT NULL THEN arg_min(account_key, (rank, account_key)) FILTER (WHERE rank IS NOT NULL) END AS account_key FROM x GROUP BY id")
def account_ladder_match(spark, d):
    accounts = table(spark, d, "supplier").select(F.col("s_nationkey").alias("provider"), F.col("s_suppkey").alias("account_key"), F.lit(None).cast("string").alias("email"), F.col("s_name").alias("profile"))
    key = F.col("c_custkey")
    subs = table(spark, d, "customer").select(key.alias("id"), F.col("c_nationkey").alias("provider"), F.when(key % 4 == 0, key % 100).alias("bound_key"), F.lit(None).cast("string").alias("email"), F.when(key % 4 == 1, F.concat(F.lit("Supplier#"), F.lpad((key % 100).cast("string"), 9, "0"))).alias("profile"))
    return M.match_accounts(subs, accounts).select("id", "rank", "account_key")


@query("SELECT c_custkey AS record, min(c_custkey) OVER (PARTITION BY c_nationkey) AS \"group\" FROM customer")
def identity_groups(spark, d):
    rows = table(spark, d, "customer")
    keys = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return I.grouped_by_identity(rows.select(F.col("c_custkey").alias("record"), keys.alias("keys")), "record", "keys")


# Exports

@query(f", {PERIODS}, s AS (SELECT period, 'tool' AS dimension, client AS name, total, cost_nano FROM p UNION ALL SELECT period, 'model', model, total, cost_nano FROM p) SELECT period, dimension, name, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano FROM s GROUP BY ALL", fact=True)
def export_snapshot_rows(spark, d):
    return X.snapshot_rows(R.period_rollup(usage_fact(spark, d), NOW, ["client", "model"]))


@query("SELECT CAST(day AS VARCHAR) || ',' || client || ',' || CAST(sum(total) AS BIGINT) || ',\"a \"\"b\"\", c\"' AS line FROM fact GROUP BY day, client", fact=True)
def export_daily_rows(spark, d):
    rows = usage_fact(spark, d).groupBy("day", "client").agg(F.sum("total").cast("long").alias("tokens"))
    return X.csv_lines(rows.withColumn("note", F.lit('a "b", c')), ["day", "client", "tokens", "note"])


@query(", s AS (SELECT device, client, session, max(ts) AS last, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL), b AS (SELECT *, CAST(sum(length(session) + 20) OVER (PARTITION BY device ORDER BY last DESC, client, session ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_so_far FROM s) SELECT device, client, session, bytes_so_far FROM b WHERE bytes_so_far <= 2000", fact=True)
def sync_budget_prefix(spark, d):
    rows = usage_fact(spark, d).groupBy("device", "client", "session").agg(F.max("ts").alias("last"), F.sum("total").cast("long").alias("total"))
    out = X.budgeted(rows, ["device"], [F.col("last").desc(), F.col("client"), F.col("session")], F.length("session") + 20, 2000)
    return out.select("device", "client", "session", F.col("bytes_so_far").cast("long").alias("bytes_so_far"))
