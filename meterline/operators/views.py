"""What the screens show: guards, preferences, remainders, captures, top lists, set operations (C14, C18, C19, D5, D6, D8, D9, D16, E5 to E7, E18, F16, F17, F19, F22 to F25, F31, F35, F36, G12, H3 to H5, H10, I1, I2, I7, M4, S23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_synthetic(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows outside of a reserved namespace."""
    return rows.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def participates(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys with any value other than 0."""
    return rows.groupBy(*keys).agg(F.bool_or(F.greatest(F.lit(0), *[F.abs(F.coalesce(F.col(v), F.lit(0))) for v in values]) > 0).alias("participates"))


def guarded(rows: DataFrame, sources: DataFrame, available: Column) -> DataFrame:
    """The rows if every source is available, else none: a partial sum would pass for a whole one."""
    gate = sources.agg(F.coalesce(F.bool_and(available), F.lit(True)).alias("_open"))
    return rows.crossJoin(F.broadcast(gate)).filter("_open").drop("_open")  # one row


def preferred(rows: DataFrame, name: str, pinned: Sequence[str], order: Sequence[str], hidden: Sequence[str]) -> DataFrame:
    """Rows without hidden names, ranked: pinned, then in saved order, then by name."""
    place = lambda names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(name)) if names else F.lit(0).cast("long")
    rank = F.when(place(pinned) > 0, place(pinned)).when(place(order) > 0, 1000 + place(order)).otherwise(1_000_000)
    return rows.filter(~F.col(name).isin(*hidden) if hidden else F.lit(True)).withColumn("rank", rank.cast("long"))


def decorated(sessions: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions with the earlier start, the later use and the project that transcripts tell."""
    s = seen.select(*keys, F.col("started_at").alias("_a"), F.col("last_used_at").alias("_b"), F.col("project").alias("_p"))
    return sessions.join(s, list(keys), "left").withColumns({"started_at": F.least("started_at", "_a"), "last_used_at": F.greatest("last_used_at", "_b"), "project": F.coalesce("_p", "project")}).drop("_a", "_b", "_p")


def live_day(live: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A live day with the messages of the stored one; growth that no component explains is unclassified."""
    old = stored.select(*keys, F.col("tokens").alias("_tokens"), F.col("messages").alias("_messages"))
    joined = live.join(old, list(keys), "left")
    return joined.withColumns({"messages": F.greatest("messages", F.coalesce("_messages", F.lit(0))), "unclassified": F.greatest(F.lit(0), F.col("tokens") - F.coalesce("_tokens", F.lit(0)))}).drop("_tokens", "_messages")


def missing_attribution(expected: DataFrame, found: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of which less is found than expected."""
    f = found.select(*keys, F.col(value).alias("_found"))
    return expected.join(f, list(keys), "left").filter(F.col(value) > F.coalesce("_found", F.lit(0))).drop("_found")


def top_by(rows: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """The n largest positive values with their share of all."""
    whole = rows.agg(F.sum(value).alias("_whole"))
    return rows.filter(F.col(value) > 0).crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.col(value) / F.col("_whole"), 9)).drop("_whole").orderBy(F.col(value).desc(), name).limit(n)  # one row


def top_name(rows: DataFrame, keys: Sequence[str], name: str, first: str, second: str) -> DataFrame:
    """The name with the largest first value, or second where no first is positive; of equal ones the smallest name (H5)."""
    any_first = F.max(first) > 0
    by = lambda v: F.min_by(name, F.struct(-F.col(v), F.col(name)))
    return rows.groupBy(*keys).agg(F.when(any_first, by(first)).otherwise(by(second)).alias("top"))


def remainder_rows(rows: DataFrame, totals: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Observations, and for each key an "unknown" one of what the total has beyond them."""
    known = rows.groupBy(*keys).agg(F.sum(value).alias("_known"))
    rest = totals.join(known, list(keys), "left").select(*keys, F.lit("unknown").alias(name), (F.col(value) - F.coalesce("_known", F.lit(0))).cast("long").alias(value)).filter(F.col(value) > 0)
    return rows.select(*keys, name, value).unionByName(rest)


def graph_json(rows: DataFrame) -> DataFrame:
    """Days with their observations as JSON, in order."""
    return rows.groupBy("day").agg(F.to_json(F.array_sort(F.collect_list(F.struct("client", "model", "tokens")))).alias("clients"))


def counts_of(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """How many rows have each of the names, with zeros."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(n,) for n in names], f"{column} string")
    return every.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").fillna(0, subset=["n"])


def aggregate_today(days: DataFrame, now: Column, plausible: Column) -> DataFrame:
    """The latest plausible day that devices report, else the clock's."""
    return days.agg(F.coalesce(F.max(F.when(plausible, F.col("day"))), F.to_date(now)).alias("today"))


def normalized_subscriptions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Subscriptions with defaults and clamps; of repeated ids the first in order (C14)."""
    n = Window.partitionBy("id").orderBy(*order)
    fixed = rows.withColumns({"amount": F.greatest(F.lit(0), F.coalesce("amount", F.lit(0))), "months": F.greatest(F.lit(1), F.least(F.lit(120), F.coalesce("months", F.lit(1)))), "currency": F.upper(F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("USD")))})
    return fixed.withColumn("_n", F.row_number().over(n)).filter("_n = 1").drop("_n")


def latest_activity(rows: DataFrame) -> DataFrame:
    """The newest row, of equal ones the smallest client."""
    return rows.orderBy(F.col("ts").desc(), "client", "event_id").limit(1)


def key_sets(left: Column, right: Column) -> dict[str, Column]:
    """Union, difference and intersection of key arrays, each distinct and in order."""
    return {"union": F.array_sort(F.array_union(left, right)), "removed": F.array_sort(F.array_except(left, right)), "kept": F.array_sort(F.array_intersect(left, right))}
