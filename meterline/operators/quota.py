"""Quota readings: windows, winners, burn rates and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent as clamp, quota_number

# Spellings of window kinds without spaces, dashes and underscores, and the ranks of a reading's status.
KINDS = {"session": ("session",), "weekly": ("weekly",), "billing": ("billing", "billingcycle", "monthly")}
STATUS_RANK = {"ok": 3, "rateLimited": 2, "sourceRateLimited": 1, "unauthorized": 1, "unavailable": 1, "error": 1}
RELEASE, RESET_SLACK_S, URGENCY_PARTS, FLOOR_S = 0.3, 30, 4, 60


def window_kind(value: Column) -> Column:
    """The kind of a window by its spelling, or null."""
    low = F.regexp_replace(F.lower(F.trim(value)), r"[_\s-]+", "")
    out = F.lit(None).cast("string")
    for kind, names in KINDS.items():
        out = F.when(low.isin(*names), kind).otherwise(out)
    return out


def window_numbers(used: Column, limit: Column, remaining: Column, percent: Column) -> dict[str, Column]:
    """used, limit and remaining as numbers, as they are given; used percent from itself or used / limit, 0 to 100; remaining percent to three places."""
    u, m, r, p = (quota_number(x) for x in (used, limit, remaining, percent))
    share = clamp(F.coalesce(p, F.when((m > 0) & u.isNotNull(), u / m * 100)))
    return {"used": u, "limit": m, "remaining": r, "used_percent": share, "remaining_percent": F.round(100 - share, 3)}


def sorted_expiries(values: Column) -> Column:
    """Distinct expirations in order (C11)."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))


def sorted_tranches(tranches: Column) -> Column:
    """Balance tranches by expiry, those without one last."""
    key = lambda x: F.coalesce(x["expires_at"], F.lit("9999-12-31").cast("timestamp"))
    return F.array_sort(tranches, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def is_configured(account: Column, status: Column) -> Column:
    return (F.coalesce(account, F.lit("")) != "") & ~F.coalesce(status, F.lit("")).isin("notConfigured", "disabled")


def is_measurable(used_percent: Column, metric: Column) -> Column:
    return used_percent.isNotNull() & (F.coalesce(metric, F.lit("")) != "credits")


def status_rank(status: Column) -> Column:
    """How good a reading's status is; those that no table names rank last."""
    rank = F.lit(0)
    for name, n in STATUS_RANK.items():
        rank = F.when(status == name, n).otherwise(rank)
    return rank


def metered_windows(windows: Column, kind: str | None = None) -> Column:
    """Of an account's windows (kind, show_meter, remaining_percent) those with a meter and something to show on it."""
    shown = lambda w: F.coalesce(w["show_meter"], F.lit(True)) & w["remaining_percent"].isNotNull()
    return F.filter(windows, lambda w: shown(w) if kind is None else shown(w) & F.coalesce(w["kind"] == kind, F.lit(False)))


def is_balance_only(windows: Column) -> Column:
    """Has the account a window of credits, and none but of credits and spending?"""
    metric = lambda w: F.coalesce(w["metric"], F.lit(""))
    return F.exists(windows, lambda w: metric(w) == "credits") & F.forall(windows, lambda w: metric(w).isin("credits", "spend"))


def winners(readings: DataFrame, keys: Sequence[str], stale: Column) -> DataFrame:
    """Of each account the reading to show: fresh, then best status, then most windows, then newest, then device."""
    best = F.struct(~stale, status_rank(F.col("status")), F.col("windows"), F.col("updated_at"), F.col("device"))
    rest = [c for c in readings.columns if c not in keys]
    return readings.groupBy(*keys).agg(F.max_by(F.struct(*rest), best).alias("w")).select(*keys, "w.*")


def carried_balance(readings: DataFrame, keys: Sequence[str], stale: Column) -> DataFrame:
    """The newest balance of a fresh reading, for a winner without one."""
    return readings.filter(~stale & F.col("balance").isNotNull()).groupBy(*keys).agg(F.max_by("balance", F.struct("updated_at", "device")).alias("balance"))


def merged_windows(windows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("updated_at", "device")) -> DataFrame:
    """Of each window key the newest observation."""
    rest = [c for c in windows.columns if c not in keys]
    return windows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("w")).select(*keys, "w.*")


def keep_last_good(rows: DataFrame, keys: Sequence[str], good: Column, order: Sequence[str], value: str, within_s: int | None = None) -> DataFrame:
    """Beside each attempt the last good value before it, if not older than within_s."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(good, F.struct(F.col(order[0]).alias("at"), F.col(value).alias("value"))), ignorenulls=True).over(over)
    fresh = F.lit(True) if within_s is None else F.unix_timestamp(F.col(order[0])) - F.unix_timestamp(F.col("_last.at")) <= within_s
    return rows.withColumn("_last", last).withColumn("last_good", F.when(fresh, F.col("_last.value"))).drop("_last")


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each sample with the one before it of the same key."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"previous_{c}": F.lag(c).over(over) for c in columns})


def burn_step(state: Column, sample: Column) -> Column:
    """One step of the burn rate: up at once, down by RELEASE; a reset (less used, or another time of reset) only sets a new base; no time passed keeps the rate, and a repeated reading all."""
    elapsed = sample["at"] - state["at"]
    instant = (sample["used"] - state["used"]) / elapsed
    reset = (sample["used"] < state["used"]) | ~sample["resets_at"].eqNullSafe(state["resets_at"])
    rate = F.when(reset | (elapsed <= 0), state["rate"]).when(instant >= state["rate"], instant).otherwise(RELEASE * instant + (1 - RELEASE) * state["rate"])
    new = lambda rate: F.struct(*[sample[c].alias(c) for c in ("at", "used", "resets_at", "updated_at")], rate.alias("rate"))
    return F.when(state["at"].isNull(), new(F.lit(0.0))).when(sample["updated_at"] == state["updated_at"], state).otherwise(new(rate))


def measured(samples: DataFrame) -> DataFrame:
    """Samples (at in seconds, seq, used; where there are such columns, status, metric, resets_at and updated_at) that measure a burn: of good readings, of windows that aren't money, with a number."""
    have = samples.columns
    good = F.col("used").isNotNull()
    if "status" in have:
        good = good & F.coalesce(F.col("status") == "ok", F.lit(False))
    if "metric" in have:
        good = good & (F.coalesce(F.col("metric"), F.lit("")) != "credits")
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    kept = samples.filter(good & (F.col("updated_at").isNotNull() if "updated_at" in have else F.lit(True)))
    return kept.withColumns({"at": F.col("at").cast("double"), "used": F.col("used").cast("double"), "resets_at": F.coalesce(text("resets_at"), F.lit("")), "updated_at": text("updated_at")})


def burn_rates(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The burn rate of each window from its samples, folded in order of (at, seq) (K13). A window's samples are bounded by its retention."""
    sample = F.struct("at", "seq", "used", "resets_at", "updated_at")
    empty = F.struct(*[F.lit(None).cast(k).alias(c) for c, k in (("at", "double"), ("used", "double"), ("resets_at", "string"), ("updated_at", "string"))], F.lit(0.0).alias("rate"))
    folded = measured(samples).groupBy(*keys).agg(F.array_sort(F.collect_list(sample)).alias("s")).withColumn("state", F.aggregate("s", empty, burn_step))
    return folded.select(*keys, "state.at", "state.used", "state.rate")


def urgency(state: DataFrame, now_s: float) -> DataFrame:
    """When each window should be read again: a quarter of the time to exhaustion after its sample, at least FLOOR_S."""
    delay = F.greatest(F.lit(float(FLOOR_S)), (100 - F.col("used")) / F.col("rate") / URGENCY_PARTS)
    return state.filter("rate > 0 and used < 100").withColumn("due", F.greatest(F.lit(float(now_s)), F.col("at") + delay))


def next_reset(windows: DataFrame, now: Column) -> DataFrame:
    """The earliest reset to come, RESET_SLACK_S later."""
    at = F.col("resets_at") + F.expr(f"INTERVAL {RESET_SLACK_S} SECONDS")
    return windows.filter(at > now).agg(F.min(at).alias("due"))


def window_sums(rows: DataFrame, now: Column, anchor: Column, value: str) -> DataFrame:
    """Sums over the last five hours, the UTC week and the month anchored at first use, half open."""
    months = F.floor(F.months_between(F.to_date(now), F.to_date(anchor))).cast("int")
    start = F.add_months(F.to_date(anchor), months).cast("timestamp")
    ts = F.col("ts")
    inside = {"session": ts >= now - F.expr("INTERVAL 5 HOURS"), "weekly": ts >= F.date_trunc("week", now), "billing": ts >= start}
    return rows.filter(ts < now).agg(*[F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0)).alias(kind) for kind, test in inside.items()])


def tightest(windows: DataFrame, account: Sequence[str], n: int, per_account: int = 2) -> DataFrame:
    """Of each account its windows with least left, and the n accounts with least left (H6, H7, H8)."""
    over = Window.partitionBy(*account).orderBy("remaining_percent", "kind")
    few = windows.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= per_account)
    return few.groupBy(*account).agg(F.min("remaining_percent").alias("least"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind"))), lambda x: x["kind"])).alias("kinds")).orderBy("least", *account).limit(n)


# Providers whose secret is typed in, so that a device has one account of each.
TYPED_IN = ("copilot", "deepseek", "minimax")


def quota_identity(provider: Column, account_key: Column, email: Column, status: Column) -> Column:
    """What tells a device's quota rows apart: the provider where its secret is typed in, else its account, e-mail or status; null without a provider."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = text(provider)
    rest = F.coalesce(text(account_key), F.concat(F.lit("email:"), F.lower(text(email))), F.coalesce(F.trim(status), F.lit("")))
    return F.when(name.isin(*TYPED_IN), name).otherwise(F.concat(name, F.lit(":"), rest))


def merged_readings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A device's new quota rows, but the stored row where a typed-in provider is configured and another runtime says that it is not.

    Rows: device, runtime, provider, account_key, email, status and others, the same in both tables; of stored rows with one identity the one with the
    largest columns counts. Providers that no longer come are gone.
    """
    named = lambda df: df.withColumn("identity", quota_identity(F.col("provider"), F.col("account_key"), F.col("email"), F.col("status")))
    rest = incoming.columns
    old = named(stored.select(*rest)).filter("identity is not null").groupBy("device", "identity").agg(F.max(F.struct(*rest)).alias("old"))
    met = named(incoming).join(old, ["device", "identity"], "left")
    runtime = lambda c: F.nullif(F.trim(c), F.lit(""))
    keep = F.col("provider").isin(*TYPED_IN) & (F.col("status") == "notConfigured") & is_configured(F.col("old.account_key"), F.col("old.status")) & (runtime(F.col("old.runtime")) != runtime(F.col("runtime")))
    return met.select(*[F.when(F.coalesce(keep, F.lit(False)), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in rest])
