"""Domain views over the star-schema test tables, and readers of usage files.

The views use integer arithmetic only, so any engine repeats them bit for bit. Costs are whole nano-dollars until they are shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 12:00:00"
TODAY, HISTORY_TODAY = "2024-01-30", "2001-08-01"
#: Which tool each event type stands for.
CLIENTS = {"view": "claude", "click": "codex", "signup": "gemini", "purchase": "cursor", "error": "opencode"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event as usage: who used what, when, how many tokens of each kind, at what cost."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    client = F.create_map(*[F.lit(x) for pair in CLIENTS.items() for x in pair])
    total = F.floor(F.col("value") * 100 + 0.5).cast("long")
    fact = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), "user_id", "event_type", "k", client[F.col("event_type")].alias("client"),
        F.concat(F.lit("model-"), (F.col("k") % 7).cast("string")).alias("model"), F.concat(F.lit("dev-"), (F.col("user_id") % 4).cast("string")).alias("device"),
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.to_date("ts").cast("string")).alias("session"),
        F.concat(F.lit("Project "), (F.col("user_id") % 10).cast("string")).alias("project"), total.alias("total"), F.floor(F.col("value") * 1_000_000 + 0.5).cast("long").alias("cost_nano"),
    )
    part = lambda share: F.floor(F.col("total") * share / 100).cast("long")
    fact = fact.withColumns({"cache_read": part(60), "cache_write": part(5), "output": part(10)})
    fact = fact.withColumn("input", F.col("total") - F.col("cache_read") - F.col("cache_write") - F.col("output"))
    return fact.withColumns({"dur_ms": F.when(F.col("k") % 3 != 0, F.col("k") * 10 + 100), "exact": F.col("k") % 11 != 0})


def long_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily usage over many years: device, day, client, model, tokens, cost_nano, messages (A2)."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")  # 25 nations
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    tokens = F.floor("o_totalprice").cast("long")
    return orders.select(F.col("o_orderkey").alias("row_id"), F.col("n_name").alias("device"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("client"), F.col("o_orderstatus").alias("model"), tokens.alias("tokens"), (tokens * 1000).alias("cost_nano"))


def usd(nano):
    """Dollars of whole nano-dollars, rounded half up to six places in integers, so that no engine's rounding matters."""
    return (F.floor((nano + 500) / 1000).cast("long").cast("double") / F.lit(1_000_000.0)).alias("cost_usd")


#: The same views as SQL. Costs are shown as in usd().
FACT_SQL = """
ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
f0 AS (SELECT event_id, ts, day, user_id, event_type, k,
  CASE event_type WHEN 'view' THEN 'claude' WHEN 'click' THEN 'codex' WHEN 'signup' THEN 'gemini' WHEN 'purchase' THEN 'cursor' WHEN 'error' THEN 'opencode' END AS client,
  'model-' || (k % 7) AS model, 'dev-' || (user_id % 4) AS device, user_id || '@' || day AS session, 'Project ' || (user_id % 10) AS project,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS total, CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS cost_nano FROM ev),
f1 AS (SELECT *, total * 60 // 100 AS cache_read, total * 5 // 100 AS cache_write, total * 10 // 100 AS output FROM f0),
fact AS (SELECT *, total - cache_read - cache_write - output AS input, CASE WHEN k % 3 <> 0 THEN k * 10 + 100 END AS dur_ms, k % 11 <> 0 AS exact FROM f1)
"""
HISTORY_SQL = """
hist AS (SELECT o_orderkey AS row_id, n_name AS device, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS client, o_orderstatus AS model,
  CAST(floor(o_totalprice) AS BIGINT) AS tokens, CAST(floor(o_totalprice) AS BIGINT) * 1000 AS cost_nano
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def usd_sql(nano: str) -> str:
    return f"CAST((CAST({nano} AS BIGINT) + 500) // 1000 AS DOUBLE) / 1000000.0"
