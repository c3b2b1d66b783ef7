"""Rollups, normalization, history and ranges over the test tables, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import history as H
from ..operators import rollup as R
from ..sources.views import FACT_SQL, HISTORY_SQL, HISTORY_TODAY, NOW, TODAY, long_history, table, usage_fact, usd, usd_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, fact: bool = False, hist: bool = False):
    """Register a query under its function's name, with its SQL over the views that it needs."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            views = ",\n".join(x for x in (FACT_SQL if fact else "", HISTORY_SQL if hist else "") if x)
            ORACLE_SQL[f.__name__] = f"WITH {views.strip()}\n{sql}" if views else sql
        return f

    return register


PERIODS = f"""p AS (SELECT *, 'all_time' AS period FROM fact UNION ALL SELECT *, 'month' FROM fact WHERE date_trunc('month', day) = date_trunc('month', DATE '{TODAY}') UNION ALL SELECT *, 'today' FROM fact WHERE day = DATE '{TODAY}')"""


def _sums(*columns: str) -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in columns)


@query(f", {PERIODS} SELECT period, client, {_sums('total', 'input', 'output', 'cache_read', 'cache_write')}, {usd_sql('sum(cost_nano)')} AS cost_usd, count(*) AS messages FROM p GROUP BY ALL", fact=True)
def period_by_client(spark, d):
    return R.period_rollup(usage_fact(spark, d), NOW, ["client"]).select("period", "client", "total", "input", "output", "cache_read", "cache_write", usd(F.col("cost_nano")), "messages")


@query(f", {PERIODS} SELECT period, {_sums('total', 'cost_nano')}, count(*) AS messages, bool_and(exact) AS exact FROM p GROUP BY ALL", fact=True)
def period_totals(spark, d):
    rows = R.with_period(usage_fact(spark, d), NOW)
    return rows.groupBy("period").agg(*R.sums(["total", "cost_nano"]), F.count(F.lit(1)).alias("messages"), F.bool_and("exact").alias("exact"))


@query(f", {PERIODS} SELECT period, model, {_sums('total', 'output', 'cost_nano')} FROM p GROUP BY ALL", fact=True)
def period_by_model(spark, d):
    return R.period_rollup(usage_fact(spark, d), NOW, ["model"]).select("period", "model", "total", "output", "cost_nano")


@query(f", {PERIODS} SELECT period, client, model, CAST(grouping(period, client, model) AS BIGINT) AS level, {_sums('total', 'cost_nano')} FROM p GROUP BY GROUPING SETS ((period), (period, client), (period, model), (period, client, model))", fact=True)
def period_by_client_model(spark, d):
    sets = R.period_sets(usage_fact(spark, d), NOW, [[], ["client"], ["model"], ["client", "model"]], ["total", "cost_nano"])
    return sets.select("period", "client", "model", "level", "total", "cost_nano")


@query(f", {PERIODS} SELECT period, device, {_sums('total', 'cost_nano')} FROM p GROUP BY ALL", fact=True)
def period_by_device(spark, d):
    return R.period_rollup(usage_fact(spark, d), NOW, ["device"], ["total", "cost_nano"]).drop("messages")


@query(f", s AS (SELECT client, session, {_sums('total', 'input', 'output', 'cost_nano')}, count(*) AS messages, min(ts) AS a, max(ts) AS b, arg_min(project, (ts, project)) AS project, count(DISTINCT model) AS models FROM fact GROUP BY ALL) SELECT client, session, total, input, output, cost_nano, messages, strftime(a, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_used_at, project, models FROM s", fact=True)
def session_rollup(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return R.sessions(usage_fact(spark, d)).select("client", "session", "total", "input", "output", "cost_nano", "messages", text("started_at"), text("last_used_at"), "project", "models")


@query(f", {PERIODS} SELECT period, lower(trim(project)) AS project_key, client, min(trim(project)) AS label, {_sums('total', 'cost_nano')} FROM p GROUP BY ALL", fact=True)
def project_rollup(spark, d):
    return R.projects(R.with_period(usage_fact(spark, d), NOW), ["period"]).select("period", "project_key", "client", "label", "total", "cost_nano")


@query(", m AS (SELECT model, CAST(sum(total) AS BIGINT) AS total FROM fact WHERE exact GROUP BY model), t AS (SELECT CAST(sum(total) AS BIGINT) AS total FROM fact) SELECT model, total FROM m WHERE total > 0 UNION ALL SELECT 'unattributed', CAST(t.total - (SELECT coalesce(sum(total), 0) FROM m WHERE total > 0) AS BIGINT) FROM t WHERE t.total > (SELECT coalesce(sum(total), 0) FROM m WHERE total > 0)", fact=True)
def attribution_remainder(spark, d):
    fact = usage_fact(spark, d)
    known = fact.filter("exact").groupBy("model").agg(F.sum("total").cast("long").alias("total"))
    return R.with_remainder(known, fact.agg(F.sum("total").cast("long").alias("total")), "model", "total")


@query(", s AS (SELECT client, CAST(sum(total) AS BIGINT) AS total, CAST(sum(cache_read) AS BIGINT) AS r, CAST(sum(cache_write) AS BIGINT) AS w, CAST(sum(output) AS BIGINT) AS o FROM fact GROUP BY client) SELECT client, r AS cache_read, w AS cache_write, o AS output, total - r - w - o AS miss, CASE WHEN total - w - o > 0 THEN CAST(floor(r * 100 / (total - w - o) + 0.5) AS BIGINT) END AS hit_percent FROM s", fact=True)
def component_breakdown(spark, d):
    sums = usage_fact(spark, d).groupBy("client").agg(*R.sums(["total", "cache_read", "cache_write", "output"]))
    closed = R.closed_components(F.col("total"), F.col("cache_read"), F.col("cache_write"), F.col("output"), F.lit(None).cast("long"), F.lit(True))
    rows = sums.select("client", *[closed[c].alias(c) for c in ("cache_read", "cache_write", "output", "miss")])
    return rows.withColumn("hit_percent", R.hit_percent(F.col("cache_read"), F.col("miss")))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 10 AS BIGINT) AS total, least(greatest(CAST(l_extendedprice AS BIGINT) % 700, 0), CAST(l_quantity * 10 AS BIGINT)) AS cache_read FROM lineitem)""")
def component_clamps(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 10).cast("long").alias("total"), (F.rint("l_extendedprice").cast("long") % 700).alias("read"))
    closed = R.closed_components(F.col("total"), F.col("read"), F.lit(0), F.lit(0), F.lit(None).cast("long"), F.lit(False))
    return rows.select("l_orderkey", "l_linenumber", "total", closed["cache_read"].alias("cache_read"))


@query(", s AS (SELECT client, model, CAST(coalesce(sum(output) FILTER (WHERE dur_ms IS NOT NULL), 0) AS BIGINT) AS timed_output, CAST(coalesce(sum(dur_ms), 0) AS BIGINT) AS duration_ms, CAST(coalesce(sum(total) FILTER (WHERE dur_ms IS NOT NULL), 0) AS BIGINT) AS timed_tokens FROM fact GROUP BY ALL) SELECT *, round(CASE WHEN duration_ms > 0 THEN timed_output * 1000 / duration_ms END, 3) AS tokens_per_second, round(CASE WHEN duration_ms > 0 THEN timed_tokens * 60000 / duration_ms END, 3) AS burn_per_minute FROM s", fact=True)
def token_rates(spark, d):
    return R.token_rates(usage_fact(spark, d), ["client", "model"])


@query(", s AS (SELECT device, client, model, CAST(sum(total) AS BIGINT) AS total FROM fact GROUP BY ALL) SELECT device, client, model, total, CAST(sum(total) OVER (PARTITION BY device, client) AS BIGINT) AS client_total, round(total / sum(total) OVER (PARTITION BY device), 9) AS share FROM s", fact=True)
def device_breakdown(spark, d):
    from pyspark.sql import Window

    rows = usage_fact(spark, d).groupBy("device", "client", "model").agg(F.sum("total").cast("long").alias("total"))
    return rows.withColumns({"client_total": F.sum("total").over(Window.partitionBy("device", "client")), "share": F.round(R.share("total", "device"), 9)})


@query(f", {PERIODS} SELECT period, {_sums('total', 'cost_nano')}, bool_and(exact) AS exact FROM p GROUP BY period", fact=True)
def partition_merge_equals_total(spark, d):
    rows = R.with_period(usage_fact(spark, d), NOW)
    part = lambda test: rows.filter(test).groupBy("period").agg(*R.sums(["total", "cost_nano"]), F.bool_and("exact").alias("exact"))
    return R.merge_periods(part("client = 'claude'"), part("client = 'codex'"), part("client not in ('claude', 'codex')"), keys=["period"])


# Normalization

SPELLINGS = ["$1,234.50", " 12 ", "", "abc", "1e3", "-7", "0", "12%", None, "1,0"]


@query("SELECT p_partkey, p_brand, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS DOUBLE) AS n, '$' || p_retailprice AS price_text, p_retailprice AS price FROM part")
def lenient_numbers(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("was"), F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price_text"))
    return rows.select("p_partkey", "p_brand", S.first_number(F.col("p_brand"), F.regexp_replace("p_brand", "^Brand#", "")).alias("n"), "price_text", S.lenient_number(F.col("price_text")).alias("price"))


RAW_CLIENTS = ["Claude Code", "codex_cli", "my pi tool", "Command-Code", "Qoder CN", "moltbot", "Some New Tool!", "gemini-cli", "pipeline"]


@query("SELECT DISTINCT event_type, CASE event_type WHEN 'view' THEN 'claude' WHEN 'click' THEN 'codex' WHEN 'signup' THEN 'pi' WHEN 'purchase' THEN 'commandcode' ELSE 'some-error-tool' END AS client FROM events")
def client_canonical(spark, d):
    raw = F.create_map(*[F.lit(x) for x in ("view", "My CLAUDE Code", "click", "codex_cli", "signup", "the pi agent", "purchase", "Command_ Code", "error", " Some  Error Tool! ")])
    return table(spark, d, "events").select("event_type", S.client_id(raw[F.col("event_type")]).alias("client")).distinct()


@query("SELECT DISTINCT p_type, CASE p_type WHEN 'STANDARD' THEN 'claude' WHEN 'ECONOMY' THEN 'codex' WHEN 'MEDIUM' THEN 'zai' WHEN 'PROMO' THEN 'qwen' WHEN 'LARGE' THEN 'cursor' END AS vendor FROM part")
def model_vendor(spark, d):
    raw = F.create_map(*[F.lit(x) for x in ("STANDARD", "Claude-Sonnet-4", "ECONOMY", "o3-mini", "MEDIUM", "glm-4.6", "PROMO", "QwQ-32B", "LARGE", "auto", "SMALL", "unknown-1")])
    return table(spark, d, "part").select("p_type", S.model_vendor(raw[F.col("p_type")]).alias("vendor")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 40 AS later, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT) AS sunday, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS INT) AS age FROM orders")
def day_arithmetic(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(day.alias("day"), F.date_add(day, 40).alias("later"), S.week_start(day).alias("monday"), S.week_start(day, 6).alias("sunday"), F.date_format(day, "yyyy-MM").alias("month"), F.datediff(F.lit(HISTORY_TODAY).cast("date"), day).alias("age")).distinct()


@query("SELECT DISTINCT day, strftime(CAST(day + 1 AS TIMESTAMP) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS today_ends, strftime(CAST(CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS month_ends FROM fact", fact=True)
def period_windows(spark, d):
    zone = "-05:00"
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return usage_fact(spark, d).select("day", text(S.day_end(F.col("day"), zone)).alias("today_ends"), text(S.month_end(F.col("day"), zone)).alias("month_ends")).distinct()


@query("SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS local_day FROM events")
def local_days(spark, d):
    return table(spark, d, "events").select("event_id", S.local_day(F.col("ts").cast("timestamp"), "-05:00").alias("local_day"))


@query("SELECT event_id, CASE WHEN n >= 999950000 THEN b // 10 || CASE WHEN b % 10 > 0 THEN '.' || b % 10 ELSE '' END || 'B' WHEN n >= 999950 THEN m // 10 || CASE WHEN m % 10 > 0 THEN '.' || m % 10 ELSE '' END || 'M' WHEN n >= 1000 THEN t // 10 || CASE WHEN t % 10 > 0 THEN '.' || t % 10 ELSE '' END || 'K' ELSE CAST(n AS VARCHAR) END AS compact FROM (SELECT event_id, total * 997 AS n, (total * 997 + 50) // 100 AS t, (total * 997 + 50000) // 100000 AS m, (total * 997 + 50000000) // 100000000 AS b FROM fact)", fact=True)
def compact_numbers(spark, d):
    rows = usage_fact(spark, d).select("event_id", (F.col("total") * 997).alias("n"))
    return rows.select("event_id", S.compact(F.col("n")).alias("compact"))


@query("SELECT event_id, CASE WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS duration FROM (SELECT event_id, CAST(floor(total * 1000 / 60000 + 0.5) AS BIGINT) AS m FROM fact)", fact=True)
def durations(spark, d):
    return usage_fact(spark, d).select("event_id", S.duration(F.col("total") * 1000).alias("duration"))


@query("SELECT c_custkey, substr(lower(c_name), 1, 1) || '***' || right(c_name, 1) || '@example.org' AS masked FROM customer")
def masked_emails(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.masked_email(F.concat(F.lower("c_name"), F.lit("@example.org"))).alias("masked"))


# History over orders

DAYS = "dd AS (SELECT day, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, count(*) AS messages FROM hist GROUP BY day)"


@query("SELECT day, client, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, count(*) AS messages FROM hist GROUP BY ALL", hist=True)
def daily_by_client(spark, d):
    return H.daily(long_history(spark, d), ["client"])


@query("SELECT strftime(day, '%Y-%m') AS month, device, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, count(*) AS messages FROM hist GROUP BY ALL", hist=True)
def monthly_rollup(spark, d):
    return H.monthly(H.daily(long_history(spark, d), ["device"]), ["device"])


@query(f", {DAYS} SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, count_if(tokens > 0) AS active_days, max(tokens) AS peak_tokens, arg_min(day, (-tokens, day)) AS peak_day, CAST(sum(messages) AS BIGINT) AS messages FROM dd", hist=True)
def history_summary(spark, d):
    return H.summary(H.daily(long_history(spark, d)))


@query(f", {DAYS}, m AS (SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(messages) AS BIGINT) AS messages FROM dd), w AS (SELECT count_if(tokens > 0) AS active_days, max(tokens) AS peak_tokens FROM dd WHERE day BETWEEN DATE '{HISTORY_TODAY}' - 369 AND DATE '{HISTORY_TODAY}') SELECT * FROM m, w", hist=True)
def merged_history_summary(spark, d):
    days = H.daily(long_history(spark, d), ["device"])
    return H.merged_summary(days, H.monthly(days, ["device"]), HISTORY_TODAY)


STREAKS = "isl AS (SELECT device, day, day - CAST(row_number() OVER (PARTITION BY device ORDER BY day) AS INT) AS island FROM (SELECT DISTINCT device, day FROM hist WHERE tokens > 0)), runs AS (SELECT device, min(day) AS a, max(day) AS b, count(*) AS n FROM isl GROUP BY device, island)"


@query(f", {STREAKS} SELECT device, max(CASE WHEN b = DATE '{HISTORY_TODAY}' THEN n ELSE 0 END) AS current_streak, max(n) AS longest_streak FROM runs GROUP BY device", hist=True)
def streaks(spark, d):
    out = H.streaks(H.daily(long_history(spark, d), ["device"]), HISTORY_TODAY, ["device"])
    return out.select("device", F.col("current_streak").cast("long").alias("current_streak"), "longest_streak")


def _level(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0 WHEN {x} / max({x}) OVER () >= 0.75 THEN 4 WHEN {x} / max({x}) OVER () >= 0.5 THEN 3 WHEN {x} / max({x}) OVER () >= 0.25 THEN 2 ELSE 1 END"


@query(f", {DAYS} SELECT day, tokens, {_level('tokens')} AS token_intensity, {_level('cost_nano')} AS cost_intensity FROM dd", hist=True)
def day_intensity(spark, d):
    return H.with_intensity(H.daily(long_history(spark, d))).select("day", "tokens", "token_intensity", "cost_intensity")


@query(", t AS (SELECT device, model, CAST(sum(tokens) AS BIGINT) AS tokens, min((day, row_id)) AS first FROM hist GROUP BY ALL) SELECT device, arg_min(model, (-tokens, first)) AS favourite, max(tokens) AS tokens FROM t GROUP BY device", hist=True)
def favorite_model(spark, d):
    return H.favourite(long_history(spark, d), "model", ["device"])


@query(f", {DAYS} SELECT * FROM dd WHERE day BETWEEN DATE '{HISTORY_TODAY}' - 369 AND DATE '{HISTORY_TODAY}'", hist=True)
def rolling_370(spark, d):
    return H.daily(H.rolling(long_history(spark, d), HISTORY_TODAY))


@query(f", {DAYS}, a AS (SELECT 'day' AS kind, CAST(day AS VARCHAR) AS name, tokens FROM dd ORDER BY day DESC LIMIT 30), b AS (SELECT 'month' AS kind, strftime(day, '%Y-%m') AS name, CAST(sum(tokens) AS BIGINT) AS tokens FROM dd GROUP BY ALL ORDER BY name DESC LIMIT 12) SELECT * FROM a UNION ALL SELECT * FROM b", hist=True)
def history_preview(spark, d):
    days = H.daily(long_history(spark, d))
    part = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), "tokens")
    return part(H.last_rows(days, 30), "day", "day").unionByName(part(H.last_rows(H.monthly(days), 12, "month"), "month", "month"))


@query("SELECT client, max(day) AS last_day FROM hist WHERE tokens > 0 GROUP BY client", hist=True)
def active_day_last_by_client(spark, d):
    return H.last_active(H.daily(long_history(spark, d), ["client"]), ["client"])


# Ranges and series

FACT_DAYS = "fd AS (SELECT user_id, day, CAST(sum(total) AS BIGINT) AS tokens FROM fact GROUP BY ALL), td AS (SELECT day, CAST(sum(tokens) AS BIGINT) AS tokens FROM fd GROUP BY day)"


def _days(spark, d, *keys):
    return usage_fact(spark, d).groupBy("day", *keys).agg(F.sum("total").cast("long").alias("tokens"))


def _range(name: str, start: str, end: str):
    sql = f", {FACT_DAYS}, c AS (SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS DATE) AS day), z AS (SELECT c.day, coalesce(tokens, 0) AS tokens FROM c LEFT JOIN td ON c.day = td.day) SELECT CAST(sum(tokens) AS BIGINT) AS tokens, count_if(tokens > 0) AS active_days, max(tokens) AS peak_tokens, count(*) AS days FROM z"

    def run(spark, d):
        days = H.filled(_days(spark, d), start, end, ["tokens"])
        return days.agg(F.sum("tokens").cast("long").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("active_days"), F.max("tokens").alias("peak_tokens"), F.count(F.lit(1)).alias("days"))

    run.__name__ = name
    query(sql, fact=True)(run)


_range("range_last7", "2024-01-24", TODAY)
_range("range_last30", "2024-01-01", TODAY)
_range("range_week", "2024-01-29", "2024-02-04")


@query(f", {FACT_DAYS}, c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-24', DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day), u AS (SELECT DISTINCT user_id FROM fact) SELECT u.user_id, c.day, coalesce(tokens, 0) AS tokens FROM u CROSS JOIN c LEFT JOIN fd ON fd.user_id = u.user_id AND fd.day = c.day", fact=True)
def zero_filled_calendar(spark, d):
    days = _days(spark, d, "user_id")
    return H.filled(days, "2024-01-24", TODAY, ["tokens"], days.select("user_id").distinct()).select("user_id", "day", "tokens")


@query(f", {FACT_DAYS}, c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day), u AS (SELECT DISTINCT user_id FROM fact), z AS (SELECT u.user_id, c.day, coalesce(tokens, 0) AS tokens FROM u CROSS JOIN c LEFT JOIN fd ON fd.user_id = u.user_id AND fd.day = c.day) SELECT user_id, CAST(date_diff('day', coalesce(max(day) FILTER (WHERE tokens <= 0), DATE '2023-12-31'), DATE '{TODAY}') AS INT) AS trailing_streak FROM z GROUP BY user_id", fact=True)
def trailing_streaks(spark, d):
    days = _days(spark, d, "user_id")
    return H.trailing_streak(H.filled(days, "2024-01-01", TODAY, ["tokens"], days.select("user_id").distinct()), TODAY, ["user_id"])


@query(f", {FACT_DAYS}, a AS (SELECT *, CAST(floor(date_diff('day', day, max(day) OVER ()) / 7) AS INT) AS age FROM td) SELECT age, min(day) AS start, max(day) AS end, arg_min(tokens, day) AS open, max(tokens) AS high, min(tokens) AS low, arg_max(tokens, day) AS close FROM a GROUP BY age", fact=True)
def candles_7d(spark, d):
    return H.candles(_days(spark, d), 7)


@query(f", {FACT_DAYS}, o AS (SELECT *, min(day) OVER () - CAST(dayofweek(min(day) OVER ()) AS INT) AS origin FROM td) SELECT day, tokens, CAST(date_diff('day', origin, day) // 7 AS INT) AS col, CAST(dayofweek(day) AS INT) AS row FROM o", fact=True)
def heatmap_grid(spark, d):
    return H.heatmap(_days(spark, d))


@query(", s AS (SELECT day, client, CAST(sum(total) AS BIGINT) AS tokens FROM fact GROUP BY ALL), r AS (SELECT client, row_number() OVER (ORDER BY sum(tokens) DESC, client) AS rank FROM s GROUP BY client) SELECT day, s.client, tokens, CAST(rank AS INT) AS rank, CAST(sum(tokens) OVER (PARTITION BY day ORDER BY rank) AS BIGINT) AS top FROM s JOIN r ON s.client = r.client", fact=True)
def stacked_bars(spark, d):
    from pyspark.sql import Window

    bars = _days(spark, d, "client")
    totals = bars.groupBy("client").agg(F.sum("tokens").alias("all_tokens"))
    ranks = totals.select("client", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("all_tokens").desc(), "client")).alias("rank"))  # a row a tool
    return bars.join(F.broadcast(ranks), "client").withColumn("top", F.sum("tokens").over(Window.partitionBy("day").orderBy("rank"))).select("day", "client", "tokens", "rank", "top")


@query(f", {DAYS}, s AS (SELECT CAST(sum(tokens) AS BIGINT) AS a, CAST(sum(messages) AS BIGINT) AS b, count_if(tokens > 0) AS c, max(tokens) AS d FROM dd) SELECT unnest(['tokens', 'messages', 'active_days', 'peak_tokens']) AS card, unnest([a, b, c, d]) AS value FROM s", hist=True)
def stat_cards(spark, d):
    cards = H.summary(H.daily(long_history(spark, d)))
    return cards.select(F.expr("stack(4, 'tokens', tokens, 'messages', messages, 'active_days', active_days, 'peak_tokens', peak_tokens) AS (card, value)"))


@query(", s AS (SELECT model, CAST(sum(total) AS BIGINT) AS tokens FROM fact GROUP BY model) SELECT model, tokens, round(tokens / sum(tokens) OVER (), 9) AS share FROM s QUALIFY row_number() OVER (ORDER BY tokens DESC, model) <= 5", fact=True)
def top5_breakdown(spark, d):
    rows = usage_fact(spark, d).groupBy("model").agg(F.sum("total").cast("long").alias("tokens")).withColumn("share", F.round(R.share("tokens"), 9))
    return rows.orderBy(F.col("tokens").desc(), "model").limit(5)


@query(f", {FACT_DAYS}, x AS (SELECT CASE rule WHEN 0 THEN 'at_least' WHEN 1 THEN 'always' ELSE 'larger' END AS rule, day, CASE WHEN day <> DATE '{TODAY}' THEN tokens WHEN rule = 1 THEN 1000 ELSE greatest(tokens, 1000) END AS tokens FROM td, (VALUES (0), (1), (2)) r(rule)) SELECT * FROM x", fact=True)
def live_today_rules(spark, d):
    days, live = _days(spark, d), spark.range(1).select(F.lit(1000).cast("long").alias("tokens"))
    parts = [H.with_live_today(days, live, TODAY, rule).select(F.lit(rule).alias("rule"), "day", "tokens") for rule in ("at_least", "always", "larger")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
