"""Devices: expiry, staleness, upserts, carries, incremental refresh and archives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import client_id, lenient_number, strict_day, utc_day

def is_open(now: Column, ends_at: Column, updated_at: Column, period: str) -> Column:
    """Does a stored period still count? Until its end; without one, while the UTC day or month is the same, or if nobody knows when it was stored; all_time always."""
    if period == "all_time":
        return F.lit(True)
    unit = {"today": "day", "month": "month"}[period]
    same = F.trunc(utc_day(updated_at), unit) == F.trunc(utc_day(now), unit) if unit == "month" else utc_day(updated_at) == utc_day(now)
    return F.when(ends_at.isNotNull(), now < ends_at).otherwise(F.coalesce(same, F.lit(True)))


def is_stale(now: Column, updated_at: Column, base_ms: Column, upload_ms: Column) -> Column:
    """Older than the base, or than two uploads if these are rarer; never with a base of 0."""
    age = F.unix_millis(now) - F.unix_millis(updated_at)
    return (base_ms > 0) & (age > F.greatest(base_ms, 2 * F.coalesce(upload_ms, F.lit(0))))


def is_plausible_day(day: Column, now: Column) -> Column:
    """Can some place on earth have this day now?"""
    return day.between(utc_day(now - F.expr("INTERVAL 12 HOURS")), utc_day(now + F.expr("INTERVAL 14 HOURS")))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the last by a total order; partial aggregation keeps one row a key and task."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(picked).select(*keys, "row.*")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, carry: Sequence[str]) -> DataFrame:
    """New records over old ones. A carried field has a has_ flag: absent keeps the old value, present null clears it."""
    old = stored.select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in stored.columns if c != key])
    new = incoming.withColumn("_new", F.lit(True))
    both = old.join(new, key, "full_outer")

    def pick(c: str) -> Column:
        newer = F.col("_new").isNotNull() & (F.col(f"has_{c}") if c in carry else F.lit(True))
        return F.when(newer, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c)

    return both.select(key, *[pick(c) for c in stored.columns if c != key])


def carry_missing(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], tracked: Column) -> DataFrame:
    """Incoming rows, and stored rows of untracked keys that they lack."""
    kept = stored.filter(~tracked).join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return incoming.unionByName(kept)


def apply_delta(base: DataFrame, fresh: DataFrame, anchor: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """base + (fresh - anchor) over all keys, never below 0: wider windows from a scan of today only."""
    part = lambda df, sign: df.select(*keys, *[(F.col(v) * sign).alias(v) for v in values])
    whole = part(base, 1).unionByName(part(fresh, 1)).unionByName(part(anchor, -1))
    return whole.groupBy(*keys).agg(*[F.greatest(F.lit(0), F.sum(v)).cast("long").alias(v) for v in values])


def replace_partitions(current: DataFrame, fresh: DataFrame, keys: Sequence[str], targets: Column) -> DataFrame:
    """Rows outside of the target partitions stay, those inside are the fresh ones."""
    return current.filter(~targets).unionByName(fresh.filter(targets))


def archive(observations: DataFrame, keys: Sequence[str], order: Sequence[str] = ("tokens", "messages", "batch")) -> DataFrame:
    """Of each key the largest observation as a whole: more tokens, then more messages, then the later batch."""
    return latest(observations, keys, [F.col(c) for c in order])


def live_identity(rows: DataFrame, keys: Sequence[str], ended: Column) -> DataFrame:
    """Snapshots of the keys whose last row has ended."""
    over = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return rows.withColumn("_n", F.row_number().over(over)).filter((F.col("_n") == 1) & ended).drop("_n")


def merge_rows(local: DataFrame, hub: DataFrame, key: str) -> DataFrame:
    """Hub records with the local ones in place of their own."""
    return hub.join(local.select(key), key, "left_anti").unionByName(local)


def carried(records: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], partial: Column) -> DataFrame:
    """Progressive previews keep the previous fields until a complete record comes."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumns({f: F.when(partial, F.coalesce(F.col(f), F.last(f, ignorenulls=True).over(over))).otherwise(F.col(f)) for f in fields})


def aggregate_devices(records: DataFrame, now: Column, period: str, values: Sequence[str], keys: Sequence[str] = (), counters: Sequence[str] = ()) -> DataFrame:
    """Sums over devices of one period's rows, without devices whose period has ended: values, and the counters of what senders left out.

    Rows: device, ends_at, updated_at, the keys, values and counters (null counts nothing). A column cost_usd is rounded to six places.
    """
    still = records.filter(is_open(now, F.col("ends_at"), F.col("updated_at"), period))
    sums = [F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in (*values, *counters)]
    out = still.groupBy(*keys).agg(*sums, F.count_distinct("device").alias("devices"))
    return out.withColumn("cost_usd", F.round("cost_usd", 6)) if "cost_usd" in values else out


def device_list(records: DataFrame, now: Column, base_ms: Column) -> DataFrame:
    """The devices in order of their ids, with their age and whether they are stale (F4). Rows: device, received_at, updated_at, upload_ms and others, one a device."""
    seen = F.coalesce("received_at", "updated_at")
    age = F.unix_millis(now) - F.unix_millis(seen)
    return records.withColumns({"age_ms": age, "stale": F.coalesce(is_stale(now, seen, base_ms, F.col("upload_ms")), F.lit(False))}).orderBy("device")


def delete_devices(stored: DataFrame, gone: DataFrame, key: str = "device") -> DataFrame:
    """The records without those of deleted devices."""
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def within_retention(rows: DataFrame, day: str, today: Column, days: int | None = None) -> DataFrame:
    """Rows with a day, not after today, and with `days` given not more than so many days before it."""
    kept = rows.filter(F.col(day).isNotNull() & (F.col(day) <= today))
    return kept if days is None else kept.filter(F.col(day) >= F.date_sub(today, days))


def normalized_days(observations: DataFrame) -> DataFrame:
    """Rows (date, client, model, tokens, messages, cost_usd, active_ms; all text or numbers as they came) by day: what a valid day observed.

    Days that are no date go; observations without tokens, messages and cost go, and days on which nothing is left and nobody was active. Of observations of one
    tool and model the last by tokens stays.
    """
    n = lambda c: F.greatest(F.lit(0), F.floor(F.coalesce(lenient_number(F.col(c)), F.lit(0.0)) + 0.5)).cast("long")
    rows = observations.select(strict_day(F.substring("date", 1, 10)).alias("date"), client_id(F.col("client")).alias("client"), F.coalesce(F.lower(F.trim("model")), F.lit("")).alias("model"), n("tokens").alias("tokens"), n("messages").alias("messages"), F.greatest(F.lit(0.0), lenient_number(F.col("cost_usd"))).alias("cost_usd"), n("active_ms").alias("active_ms"))
    rows = rows.filter("date is not null")
    seen = F.col("client").isNotNull() & ((F.col("tokens") > 0) | (F.col("messages") > 0) | (F.col("cost_usd") > 0))
    one = rows.filter(seen).groupBy("date", "client", "model").agg(F.max_by(F.struct("tokens", "messages", "cost_usd"), F.struct("tokens", "messages", "cost_usd")).alias("o"))
    days = one.groupBy("date").agg(F.count(F.lit(1)).alias("observations"), F.sum("o.tokens").alias("tokens"), F.sum("o.messages").alias("messages"), F.round(F.sum("o.cost_usd"), 6).alias("cost_usd"))
    active = rows.groupBy("date").agg(F.max("active_ms").alias("active_ms"))
    out = active.join(days, "date", "left").filter("observations is not null or active_ms > 0")
    return out.select("date", "active_ms", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("observations", "tokens", "messages", "cost_usd")])


# Seconds after which a full scan is due.
FULL_SCAN_S = 60 * 60


def scan_plan(ticks: DataFrame, keys: Sequence[str], full_s: int = FULL_SCAN_S) -> DataFrame:
    """What each tick of an interval does: 'full' first and when the last full scan is full_s old, 'anchored' if something changed since the tick before, else 'skip' (K4).

    Ticks: the keys, at (seconds), and changed; of ticks at one time the first is without a change, if there is one. Only the times of full scans are folded in
    order, of a key's distinct times, which are bounded by the time that a key covers, so days belong into it; ticks meet them in a join.
    """
    rows = ticks.withColumn("at", F.col("at").cast("long"))
    start = F.struct(F.lit(None).cast("long").alias("full_at"), F.array().cast("array<long>").alias("fulls"))

    def step(s: Column, t: Column) -> Column:
        full = s["full_at"].isNull() | (t - s["full_at"] >= full_s)
        return F.when(full, F.struct(t.alias("full_at"), F.concat(s["fulls"], F.array(t)).alias("fulls"))).otherwise(s)

    times = rows.filter("at is not null").select(*keys, "at").distinct()
    fulls = times.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list("at")), start, step)["fulls"].alias("fulls")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode("fulls").alias("_at"))
    first = F.row_number().over(Window.partitionBy(*keys, "at").orderBy("changed")) == 1
    met = rows.withColumn("_first", first).join(fulls, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("at") == F.col("_at")), "left")
    full = F.col("at").isNull() | (F.col("_first") & F.col("_at").isNotNull())
    return met.select(*keys, "at", F.when(full, "full").when(F.coalesce(F.col("changed"), F.lit(False)), "anchored").otherwise("skip").alias("scan"))
