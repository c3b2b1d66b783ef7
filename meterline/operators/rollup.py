"""Rollups of usage rows by period and dimension, sessions, projects, remainders and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("total", "input", "output", "cache_read", "cache_write", "cost_nano")


def with_period(fact: DataFrame, now: str) -> DataFrame:
    """A row for each of the periods today, month and all_time to which a usage row belongs; undated rows are all_time's only."""
    day = F.to_date(F.lit(now).cast("timestamp"))
    names = F.array_compact(F.array(F.lit("all_time"), F.when(F.trunc("day", "month") == F.trunc(day, "month"), "month"), F.when(F.col("day") == day, "today")))
    return fact.withColumn("period", F.explode(names))


def sums(columns: Sequence[str] = PARTS) -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in columns]


def period_rollup(fact: DataFrame, now: str, keys: Sequence[str] = (), columns: Sequence[str] = PARTS) -> DataFrame:
    """Sums by period and keys, in one pass over the rows and one combined shuffle."""
    return with_period(fact, now).groupBy("period", *keys).agg(*sums(columns), F.count(F.lit(1)).alias("messages"))


def period_sets(fact: DataFrame, now: str, sets: Sequence[Sequence[str]], columns: Sequence[str] = PARTS) -> DataFrame:
    """Sums of several sets of keys at once; a key that a set lacks is null (F1, F2)."""
    every = sorted({k for s in sets for k in s})
    grouped = with_period(fact, now).groupingSets([["period", *s] for s in sets], "period", *every)
    return grouped.agg(F.grouping_id("period", *every).cast("long").alias("level"), *sums(columns))


def merge_periods(*parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rollups of disjoint row sets as one: sums add, exactness holds only if it holds everywhere."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    rest = [c for c in whole.columns if c not in keys and c != "exact"]
    exact = [F.bool_and("exact").alias("exact")] if "exact" in whole.columns else []
    return whole.groupBy(*keys).agg(*sums(rest), *exact)


def sessions(fact: DataFrame, keys: Sequence[str] = ("client", "session")) -> DataFrame:
    """Sessions: counters add, first start, last use, the first project that is not empty (by time, then name)."""
    project = F.min(F.when(F.coalesce("project", F.lit("")) != "", F.struct("ts", "project")))["project"]
    return fact.groupBy(*keys).agg(*sums(), F.count(F.lit(1)).alias("messages"), F.min("ts").alias("started_at"), F.max("ts").alias("last_used_at"), project.alias("project"), F.count_distinct("model").alias("models"))


def projects(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Projects by canonical key: their smallest label, and sums by tool."""
    keyed = rows.withColumn("project_key", F.lower(F.trim("project"))).filter(F.coalesce("project_key", F.lit("")) != "")
    label = keyed.groupBy("project_key").agg(F.min(F.trim("project")).alias("label"))
    return keyed.groupBy("project_key", "client", *keys).agg(F.sum("total").cast("long").alias("total"), F.sum("cost_nano").cast("long").alias("cost_nano")).join(label, "project_key")


def with_remainder(rows: DataFrame, totals: DataFrame, key: str, value: str, name: str = "unattributed") -> DataFrame:
    """Positive entries of a map, and what the scalar total has beyond them."""
    kept = rows.filter(F.col(value) > 0).select(key, value)
    known = kept.agg(F.coalesce(F.sum(value), F.lit(0)).alias("known"))
    rest = totals.select(F.col(value).alias("whole")).crossJoin(known).select(F.lit(name).alias(key), (F.col("whole") - F.col("known")).cast("long").alias(value)).filter(F.col(value) > 0)  # one row by one row
    return kept.unionByName(rest)


def closed_components(total: Column, read: Column, write: Column, output: Column, unclassified: Column, exact: Column) -> dict[str, Column]:
    """Components clamped so that they close over the total; without an exact split what is not known is unclassified."""
    cap = lambda x, room: F.greatest(F.lit(0), F.least(F.coalesce(x, F.lit(0)), room))
    r = cap(read, total)
    w = cap(write, total - r)
    o = cap(output, total - r - w)
    u = cap(F.coalesce(unclassified, F.when(exact, F.lit(0)).otherwise(total - r - w - o)), total - r - w - o)
    return {"cache_read": r, "cache_write": w, "output": o, "unclassified": u, "miss": total - r - w - o - u}


def hit_percent(read: Column, miss: Column) -> Column:
    """Cached input as a whole percentage of all input, or null."""
    return F.when(read + miss > 0, F.floor(read * 100 / (read + miss) + 0.5).cast("long"))


def token_rates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens a second and a minute of timed rows: numerators and durations are summed first, never averaged."""
    timed = F.when(F.col("dur_ms").isNotNull(), F.col("output"))
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum(timed), F.lit(0)).cast("long").alias("timed_output"), F.coalesce(F.sum("dur_ms"), F.lit(0)).cast("long").alias("duration_ms"), F.coalesce(F.sum(F.when(F.col("dur_ms").isNotNull(), F.col("total"))), F.lit(0)).cast("long").alias("timed_tokens"))
    rate = lambda x, unit: F.least(F.lit(1e12), F.try_divide(x * unit, F.col("duration_ms")))
    return out.withColumns({"tokens_per_second": F.round(rate(F.col("timed_output"), 1000), 3), "burn_per_minute": F.round(rate(F.col("timed_tokens"), 60000), 3)})


def share(value: str, *partition: str) -> Column:
    """A value's share of its partition's sum."""
    from pyspark.sql import Window

    whole = F.sum(value).over(Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0)))
    return F.when(whole > 0, F.col(value) / whole)
