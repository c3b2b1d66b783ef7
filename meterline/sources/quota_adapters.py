"""Quota answers of each provider as window rows (O1 to O21): JSON to columns, no network.

An adapter is a function from a JSON column to an array of windows. All numbers go through the same clamps as any window (C9).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at_least, percent as clamp, quota_number
from ..operators.quota import window_numbers

WINDOW = "struct<kind:string,metric:string,label:string,used:double,limit:double,remaining:double,used_percent:double,resets_at:string,minutes:int,show_meter:boolean>"


def at(body: Column, *paths: str) -> Column:
    """The text at the first of the paths that holds one."""
    return F.coalesce(*[F.nullif(F.get_json_object(body, f"$.{p}"), F.lit("")) for p in paths])


def number(body: Column, *paths: str) -> Column:
    return quota_number(at(body, *paths))


def iso(x: Column) -> Column:
    """An ISO instant from epoch seconds, milliseconds or text."""
    n = x.try_cast("double")
    when = F.when(n.isNull(), F.try_to_timestamp(x)).when(n < 20_000_000_000, F.timestamp_seconds(n)).otherwise(F.timestamp_millis(n.cast("long")))
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window(kind, label=None, percent=None, used=None, limit=None, remaining=None, resets=None, minutes=None, metric=None, show=True, when=None) -> Column:
    """A window, or null where `when` is false."""
    col = lambda x, kind="string": x if isinstance(x, Column) else F.lit(x).cast(kind)
    none = F.lit(None).cast("double")
    n = window_numbers(col(used, "double"), col(limit, "double"), col(remaining, "double"), col(percent, "double")) if (used is not None or percent is not None or remaining is not None) else dict.fromkeys(("used", "limit", "remaining", "used_percent"), none)
    out = F.struct(
        col(kind).alias("kind"), col(metric).alias("metric"), col(label).alias("label"), n["used"].cast("double").alias("used"), n["limit"].cast("double").alias("limit"), n["remaining"].cast("double").alias("remaining"),
        n["used_percent"].cast("double").alias("used_percent"), col(resets).alias("resets_at"), col(minutes, "int").alias("minutes"), col(show, "boolean").alias("show_meter"),
    ).cast(WINDOW)
    return out if when is None else F.when(when, out)


def windows(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda w: w.isNotNull())


def claude(b: Column) -> Column:
    part = lambda kind, *names: window(kind, percent=number(b, *[f"{n}.utilization" for n in names]), resets=iso(at(b, *[f"{n}.resets_at" for n in names])), when=at(b, *names).isNotNull())
    scale = lambda x: F.pow(F.lit(10.0), F.coalesce(number(b, f"spend.{x}.exponent"), F.lit(2.0)))
    places = F.pow(F.lit(10.0), F.coalesce(number(b, "extra_usage.decimal_places"), F.lit(2.0)))
    used = F.coalesce(number(b, "spend.used.amount_minor") / scale("used"), number(b, "extra_usage.used_credits") / places)
    limit = F.coalesce(number(b, "spend.limit.amount_minor") / scale("limit"), number(b, "extra_usage.monthly_limit") / places)
    enabled = (F.coalesce(at(b, "spend.enabled"), F.lit("")) == "true") | (F.coalesce(at(b, "extra_usage.is_enabled"), F.lit("")) == "true")
    spend = window("billing", "Usage credits", used=used, limit=limit, metric="spend", show=limit.isNotNull(), when=enabled & used.isNotNull())
    scoped = F.from_json(at(b, "limits"), "array<struct<kind:string,scope:struct<model:struct<display_name:string>>,utilization:double,percent:double,resets_at:string>>")
    first = F.get(F.filter(scoped, lambda x: (x["kind"] == "weekly_scoped") & (F.lower(F.trim(x["scope"]["model"]["display_name"])) == "fable")), F.lit(0))
    weekly = window("weekly", first["scope"]["model"]["display_name"], percent=F.coalesce(first["utilization"], first["percent"]), resets=iso(first["resets_at"]), when=first.isNotNull())
    return windows(part("session", "five_hour", "fiveHour"), part("weekly", "seven_day", "sevenDay"), weekly, spend)


def claude_text(b: Column) -> Column:
    left = lambda name: quota_number(F.nullif(F.regexp_extract(b, rf"(?is){name}[^%]*?(\d+(?:\.\d+)?)%\s*left", 1), F.lit("")))
    part = lambda kind, name, minutes: window(kind, percent=clamp(100 - left(name)), minutes=minutes, when=left(name).isNotNull())
    return windows(part("session", "current session", 300), part("weekly", "current week", 10080))


def codex(b: Column) -> Column:
    def part(name: str) -> Column:
        p = [f"{name}", f"rate_limits.{name}", f"rateLimits.{name}"]
        minutes = number(b, *[f"{x}.{y}" for x in p for y in ("windowDurationMins", "window_duration_mins")])
        kind = F.when(minutes == 43200, "billing").when(minutes >= 10080, "weekly").when(minutes == 300, "session").otherwise("weekly" if name == "secondary" else "session")
        return window(kind, F.when(minutes == 43200, "Monthly"), percent=number(b, *[f"{x}.{y}" for x in p for y in ("usedPercent", "used_percent")]), resets=iso(at(b, *[f"{x}.{y}" for x in p for y in ("resetsAt", "resets_at")])), minutes=minutes.cast("int"), when=at(b, *p).isNotNull())

    return windows(part("primary"), part("secondary"))


def cursor(b: Column) -> Column:
    used, limit = number(b, "requests.used", "used"), number(b, "requests.limit", "limit")
    plan, auto = number(b, "plan.totalPercentUsed"), number(b, "plan.autoPercentUsed")
    resets = iso(at(b, "billingCycleEnd", "plan.billingCycleEnd"))
    total = F.when(limit > 0, used / limit * 100).otherwise(plan)
    return windows(window("billing", "Total", percent=total, used=used, limit=limit, remaining=F.when(limit > 0, at_least(limit - used)), resets=resets, when=total.isNotNull()), window("billing", "Auto", percent=auto, resets=resets, when=auto.isNotNull()))


def antigravity(b: Column) -> Column:
    groups = F.from_json(at(b, "response.groups", "summary.groups", "groups"), "array<struct<displayName:string,buckets:array<struct<window:string,remainingFraction:double,resetTime:string,disabled:boolean>>>>")
    flat = F.flatten(F.transform(groups, lambda g: F.transform(g["buckets"], lambda x: F.struct(g["displayName"].alias("name"), x.alias("b")))))
    kind = lambda x: F.when(F.lower(x["b"]["window"]).rlike("5|session|hour"), "session").when(F.lower(x["b"]["window"]).rlike("week"), "weekly")
    fraction = lambda x: F.when(~F.coalesce(x["b"]["disabled"], F.lit(False)), x["b"]["remainingFraction"])
    made = F.transform(flat, lambda x: window(kind(x), F.concat(x["name"], F.when(kind(x) == "session", " 5-hour").otherwise(" weekly")), percent=clamp(100 - fraction(x) * 100), resets=iso(x["b"]["resetTime"]), show=fraction(x).isNotNull(), when=kind(x).isNotNull()))
    return F.filter(made, lambda w: w.isNotNull())


def opencode(b: Column) -> Column:
    def part(kind: str, name: str) -> Column:
        percent = F.coalesce(number(b, f"go.{name}.usagePercent"), number(b, f"web.{name}.usagePercent"), number(b, f"local.{name}.usagePercent"))  # by priority of source
        return window(kind, percent=percent, resets=iso(at(b, f"go.{name}.resetsAt", f"web.{name}.resetsAt", f"local.{name}.resetsAt")), when=percent.isNotNull())

    balance = number(b, "zen.balance")
    return windows(part("session", "rolling"), part("weekly", "weekly"), part("billing", "monthly"), window("billing", "Zen", remaining=balance, metric="credits", show=False, when=balance.isNotNull()))


def openrouter(b: Column) -> Column:
    limit, usage, left = number(b, "data.limit"), number(b, "data.usage"), number(b, "data.limit_remaining")
    used = at_least(F.coalesce(usage, limit - left))
    reset = F.lower(F.trim(F.coalesce(at(b, "data.limit_reset"), F.lit(""))))
    kind = F.when(reset == "daily", "session").when(reset == "weekly", "weekly").otherwise("billing")
    label = F.when(reset.isin("daily", "weekly", "monthly"), F.concat(F.initcap(reset), F.lit(" limit"))).otherwise("API key limit")
    key = window(kind, label, used=used, limit=limit, remaining=at_least(F.coalesce(left, limit - used)), when=(limit > 0) & used.isNotNull())
    total, spent = number(b, "credits.total_credits"), number(b, "credits.total_usage")
    credits = window("billing", "Credits", used=spent, limit=total, remaining=at_least(total - spent), percent=F.when(total > 0, spent / total * 100).otherwise(100.0), metric="credits", when=(total >= 0) & (spent >= 0))
    return windows(key, credits)


def deepseek(b: Column) -> Column:
    left, spent = number(b, "balance_infos[0].total_balance"), F.coalesce(number(b, "month_spend"), F.lit(0.0))
    return windows(window("billing", "Balance", used=spent, limit=left + spent, remaining=left, metric="credits", when=left.isNotNull()))


def minimax(b: Column) -> Column:
    def part(kind: str, label: str, name: str, end: str, minutes: int) -> Column:
        left, status = number(b, f"current_{name}_remaining_percent"), number(b, f"current_{name}_status")
        placeholder = F.coalesce(status == 3, F.lit(False)) & (left.isNull() | (left >= 100))
        return window(kind, label, percent=clamp(100 - left), resets=iso(at(b, end)), minutes=minutes, when=left.isNotNull() & ~placeholder)

    return windows(part("session", "5h", "interval", "end_time", 300), part("weekly", "Weekly", "weekly", "weekly_end_time", 10080))


def mimo(b: Column) -> Column:
    month = "struct<used:double,limit:double,percent:double,items:array<struct<name:string,used:double,limit:double,percent:double>>>"
    usage = F.from_json(at(b, "data.monthUsage", "data.month_usage", "monthUsage"), month)
    item = F.get(F.filter(usage["items"], lambda x: F.lower(x["name"]) == "month_total_token"), F.lit(0))
    some = F.coalesce(F.size(usage["items"]) > 0, F.lit(False))
    pick = lambda c: F.when(some, item[c]).otherwise(usage[c])
    plan = window("billing", "Token plan", used=pick("used"), limit=pick("limit"), remaining=at_least(pick("limit") - pick("used")), percent=F.coalesce(pick("percent"), pick("used") / pick("limit") * 100), when=pick("limit") > 0)
    balance = number(b, "balance", "data.balance")
    return windows(plan, window("billing", "Balance", remaining=balance, metric="credits", show=False, when=balance.isNotNull()))


def _cycle_label(start: Column, end: Column) -> Column:
    days = F.round((F.unix_timestamp(F.try_to_timestamp(end)) - F.unix_timestamp(F.try_to_timestamp(start))) / 86400)
    return F.when(days.between(4, 12), "Weekly").when(days.isNull() | (days <= 0) | days.between(20, 45), "Monthly").otherwise("Billing")


def grok(b: Column) -> Column:
    percent = number(b, "config.creditUsagePercent", "creditUsagePercent")
    start, end = at(b, "config.currentPeriod.start", "currentPeriod.start"), at(b, "config.currentPeriod.end", "currentPeriod.end")
    kind = F.upper(F.coalesce(at(b, "config.currentPeriod.type", "currentPeriod.type"), F.lit("")))
    label = F.when(kind.contains("WEEK"), "Weekly").when(kind.contains("MONTH"), "Monthly").otherwise(_cycle_label(start, end))
    used, limit = number(b, "config.used", "config.totalUsed", "config.usage.totalUsed", "used"), number(b, "config.monthlyLimit", "monthlyLimit")
    old_start, old_end = at(b, "config.billingPeriodStart", "config.billingCycle.billingPeriodStart"), at(b, "config.billingPeriodEnd", "config.billingCycle.billingPeriodEnd")
    new = window("billing", label, percent=clamp(percent), resets=iso(end), when=percent.isNotNull())
    old = window("billing", _cycle_label(old_start, old_end), percent=clamp(used / limit * 100), resets=iso(old_end), when=percent.isNull() & (limit > 0) & used.isNotNull())
    return windows(new, old)


def copilot(b: Column) -> Column:
    resets = iso(at(b, "quotaResetDate", "quota_reset_date"))

    def part(label: str, name: str) -> Column:
        left = number(b, f"{name}.percentRemaining", f"quota_snapshots.{name}.percent_remaining")
        unlimited = F.coalesce(at(b, f"{name}.unlimited"), F.lit("false")) == "true"
        return window("billing", label, percent=at_least(100 - left), resets=F.when(~unlimited, resets), when=left.isNotNull())

    return windows(part("Premium", "premium"), part("Chat", "chat"))


def kiro(b: Column) -> Column:
    pair = lambda name, i: quota_number(F.nullif(F.regexp_extract(b, rf"(?i){name}[^\d]*([\d.]+)\s*(?:/|of)\s*([\d.]+)", i), F.lit("")))
    over = quota_number(F.nullif(F.regexp_extract(b, r"(?i)overages?[^\d]*([\d.]+)", 1), F.lit("")))
    return windows(window("billing", "Credits", used=pair(r"(?<!bonus )credits", 1), limit=pair(r"(?<!bonus )credits", 2), when=pair(r"(?<!bonus )credits", 2) > 0), window("billing", "Bonus", used=pair("bonus credits", 1), limit=pair("bonus credits", 2), when=pair("bonus credits", 2) > 0), window("billing", "Overage", used=over, show=False, when=over.isNotNull()))


def zai(b: Column) -> Column:
    schema = "array<struct<type:string,unit:int,number:double,percentage:double,remaining:double,nextResetTime:string>>"
    limits = F.filter(F.from_json(at(b, "data.limits"), schema), lambda x: x["percentage"].isNotNull())
    minutes = lambda x: x["number"] * F.when(x["unit"] == 5, 1).when(x["unit"] == 3, 60).when(x["unit"] == 1, 1440).when(x["unit"] == 6, 10080)
    key = lambda x: F.coalesce(minutes(x), F.lit(1e18))
    tokens = F.array_sort(F.filter(limits, lambda x: F.upper(x["type"]).isin("TOKENS_LIMIT", "CREDIT_LIMIT")), lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))
    time = F.try_element_at(F.filter(limits, lambda x: F.upper(x["type"]) == "TIME_LIMIT"), F.lit(-1))
    n, first, last = F.size(tokens), F.get(tokens, F.lit(0)), F.try_element_at(tokens, F.lit(-1))
    short = (n >= 2) | F.coalesce(minutes(first) <= 360, F.lit(False))
    part = lambda kind, label, x, when: window(kind, label, percent=x["percentage"], resets=iso(x["nextResetTime"]), minutes=minutes(x).cast("int"), when=when)
    mcp = window("billing", "MCP", percent=time["percentage"], remaining=time["remaining"], resets=iso(time["nextResetTime"]), when=time.isNotNull())
    return windows(part("session", "5-hour", first, (n >= 1) & short), part("weekly", "Weekly", last, (n >= 2) | ((n == 1) & ~short)), mcp)


def volcengine(b: Column) -> Column:
    rows = F.from_json(at(b, "Result.Quotas", "quotas"), "array<struct<Level:string,Percent:double,ResetTimestamp:string>>")
    level = lambda x: F.lower(F.trim(x["Level"]))
    kind = lambda x: F.when(level(x).isin("session", "5-hour", "five_hour", "5h"), "session").when(level(x).isin("weekly", "week"), "weekly").when(level(x).isin("monthly", "month"), "billing")
    label = lambda x: F.when(kind(x) == "session", "5-hour").when(kind(x) == "weekly", "Weekly").otherwise("Monthly")
    return F.filter(F.transform(rows, lambda x: window(kind(x), label(x), percent=x["Percent"], resets=iso(x["ResetTimestamp"]), when=kind(x).isNotNull() & x["Percent"].isNotNull())), lambda w: w.isNotNull())


def commandcode(b: Column) -> Column:
    def part(kind: str, name: str, minutes: int) -> Column:
        p = [f"credits.windowLimits.{name}", f"windowLimits.{name}"]
        limit, used = number(b, *[f"{x}.{y}" for x in p for y in ("cap", "limit")]), F.coalesce(number(b, *[f"{x}.used" for x in p]), F.lit(0.0))
        return window(kind, used=at_least(used), limit=limit, remaining=at_least(limit - at_least(used)), resets=iso(at(b, *[f"{x}.resetAt" for x in p])), minutes=minutes, when=limit > 0)

    grant, bought = number(b, "credits.monthlyCredits"), F.greatest(F.lit(0.0), F.coalesce(number(b, "credits.purchasedCredits"), F.lit(0.0)))
    return windows(part("session", "fiveHour", 300), part("weekly", "weekly", 10080), window("billing", "Monthly", remaining=grant, metric="credits", show=False, when=grant.isNotNull()), window("billing", "Top-up", remaining=bought, metric="credits", show=False, when=bought > 0))


def qoder(b: Column) -> Column:
    def part(name: str) -> dict[str, Column]:
        used, limit, left = (number(b, *[f"{x}{name}.quotaSummary.{field}" for x in ("data.", "")]) for field in ("usedValue", "limitValue", "remainingValue"))
        return {"used": used, "limit": limit, "remaining": at_least(F.coalesce(left, limit - used))}

    own, shared = part("totalQuota"), part("sharedQuota")
    both = F.coalesce((shared["used"] >= 0) & (shared["limit"] >= 0), F.lit(False))
    used, limit, left = (own[c] + F.when(both, shared[c]).otherwise(0.0) for c in ("used", "limit", "remaining"))
    percent = F.when(limit > 0, used / limit * 100).otherwise(100.0)
    return windows(window("billing", "Credits", used=used, limit=limit, remaining=left, percent=percent, resets=iso(at(b, "data.nextResetAt", "nextResetAt")), when=(own["used"] >= 0) & (own["limit"] >= 0)))


def ollama(b: Column) -> Column:
    part = lambda kind, name: window(kind, percent=quota_number(F.nullif(F.regexp_extract(b, rf"(?is){name} usage.*?([\d.]+)% used", 1), F.lit(""))), when=b.rlike(rf"(?is){name} usage.*?[\d.]+% used"))
    return windows(part("session", "session"), part("weekly", "weekly"))


def kimi(b: Column) -> Column:
    def part(kind: str, label: str, minutes: int, *names: str) -> Column:
        percent = F.coalesce(*[number(b, f"{n}.ratio", f"{n}.usedRatio") * 100 for n in names])  # sources in order: the first of a kind wins
        return window(kind, label, percent=clamp(percent), resets=iso(at(b, *[f"{n}.resetTime" for n in names])), minutes=minutes, when=percent.isNotNull())

    return windows(part("session", "5-hour", 300, "rateLimit5h", "session"), part("weekly", "Weekly", 10080, "rateLimit7d", "weekly"))


def thirdparty(b: Column) -> Column:
    unit = F.coalesce(number(b, "quota_unit"), F.lit(1.0))
    left, used, total = number(b, "remaining") / unit, number(b, "used") / unit, number(b, "total") / unit
    whole = F.coalesce(total, left + used)
    spent = F.coalesce(used, at_least(whole - left))
    unlimited = F.coalesce(at(b, "unlimited"), F.lit("")) == "true"
    free = window("billing", F.coalesce(at(b, "label"), F.lit("Unlimited")), metric="credits", show=False, when=unlimited)
    paid = window("billing", at(b, "label"), used=spent, limit=whole, remaining=left, percent=F.when(whole > 0, spent / whole * 100).when(whole.isNotNull(), 100.0), metric="credits", show=whole.isNotNull(), when=~unlimited & left.isNotNull() & ~F.coalesce(total < left, F.lit(False)))
    return windows(free, paid)


ADAPTERS: dict[str, Callable[[Column], Column]] = {
    "claude": claude, "claude_text": claude_text, "codex": codex, "cursor": cursor, "antigravity": antigravity, "opencode": opencode, "openrouter": openrouter, "deepseek": deepseek,
    "minimax": minimax, "mimo": mimo, "grok": grok, "copilot": copilot, "kiro": kiro, "zai": zai, "zaiteam": zai, "volcengine": volcengine, "commandcode": commandcode, "qoder": qoder,
    "ollama": ollama, "kimi": kimi, "thirdparty": thirdparty,
}


def quota_windows(answers: DataFrame, provider: str, body: str = "body") -> DataFrame:
    """The windows of one provider's answers, a row each, beside the answers' other columns."""
    found = ADAPTERS[provider](F.col(body))
    return answers.withColumn("_w", F.explode(found)).drop(body).select("*", "_w.*").drop("_w")
