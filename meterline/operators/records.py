"""Records as devices send them, brought to one shape and shown: sessions, devices, quota readings, health, live days.

Records arrive as JSON text in a column; a text that is not an object gives no row. Nulls and fields of another type count as not sent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.files import ALIASES, TEXT_ALIASES
from .quota import sorted_tranches, window_kind, window_numbers
from .rollup import closed_components

# Quota providers, statuses, sources and details of a reading, metrics and sources of a window, kinds of window in order.
PROVIDERS = [
    "claude", "codex", "opencode", "cursor", "antigravity", "kimi", "grok", "copilot", "commandcode", "mimo", "zai", "zaiteam", "kiro", "qoder",
    "deepseek", "openrouter", "minimax", "volcengine", "ollama", "thirdparty",
]
STATUSES = ["ok", "disabled", "notConfigured", "unauthorized", "rateLimited", "sourceRateLimited", "unavailable", "error"]
SOURCES, DETAILS = ["oauth", "cli", "web", "rpc", "local", "api"], ["app", "cli", "ide", "managed", "unknown"]
METRICS, WINDOW_SOURCES, WINDOW_ORDER = ["credits", "spend"], ["web", "local"], ["session", "weekly", "billing"]
# Collection states, codes of diagnostics, and how many checks and diagnostics a tool's health may have.
COLLECTION = ["direct", "idle", "pending", "ok", "failed", "unknown"]
DIAGNOSTICS = ["source-missing", "sync-failed", "sync-timeout", "sync-spawn-failed", "sync-exit-error", "no-usage-observed", "wsl-detected-no-data"]
MOST_CHECKS, MOST_DIAGNOSTICS = 12, 4
# The intervals of upload that can be chosen, in milliseconds.
UPLOAD_INTERVALS_MS = [0, 600_000, 1_200_000, 1_800_000]


def _text(value: Column, name: str) -> Column:
    return F.get_json_object(value, f"$.{name}")


def _sent(value: Column, *names: str) -> Column:
    """The first field that is sent and not null, as text."""
    return F.coalesce(*[_text(value, n) for n in names])


def _trimmed(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def _known(value: Column, names: Sequence[str], other: str | None) -> Column:
    return F.when(value.isin(*names), value).otherwise(F.lit(other))


def _time(value: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(value), F.lit("")))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row, however often it is used: the optimizer copies no expression through a generator."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _summed(rows: DataFrame, name: str, key, number) -> DataFrame:
    """A column of maps from names to numbers as text, with spellings of one name summed; entries without a name go. A map holds one record's models or providers."""
    zero = number(F.lit("0"))
    entry = lambda e: F.struct(key(e["key"]).alias("k"), number(e["value"]).alias("v"))
    pairs = F.transform(F.map_entries(F.coalesce(F.col(name), F.create_map().cast("map<string,string>"))), entry)
    rows = rows.withColumn(name, F.filter(pairs, lambda p: p["k"].isNotNull()))
    total = lambda k: F.aggregate(F.filter(name, lambda p: p["k"] == k), zero, lambda s, p: s + p["v"])
    names = F.array_distinct(F.transform(name, lambda p: p["k"]))
    return rows.withColumn(name, F.map_from_entries(F.transform(names, lambda k: F.struct(k, total(k)))))


def _first_number(v: Column, names: Sequence[str]) -> Column:
    """As first_number, over a list: a chain of so many tests would outgrow one method's code."""
    numbers = F.transform(F.array(*[v[n] for n in names]), lambda x: S.lenient_number(x))
    return F.coalesce(F.get(F.filter(numbers, lambda x: x != 0), F.lit(0)), F.lit(0.0))


def _first_text(*values: Column) -> Column:
    """As first_text, over a list."""
    return F.coalesce(F.get(F.filter(F.transform(F.array(*values), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


_CLIENTS = ("client", "source", "platform", "agent", "tool")
_TOTALS, _COSTS = ("totalTokens", "total_tokens", "tokens"), ("costUsd", "cost_usd", "cost")
_PARTS = ("input", "output", "cache_read", "cache_write")
_SESSION_TEXTS = {n for kind in (*_PARTS, "reasoning", "messages") for n in ALIASES[kind]} | {n for kind in ("session", "started_at", "last_used_at") for n in TEXT_ALIASES[kind]}
_SESSION = ", ".join([
    *[f"`{n}` string" for n in sorted(_SESSION_TEXTS | {*_CLIENTS, *_TOTALS, *_COSTS, "projectId", "project_id", "projectLabel", "project_label"})],
    *[f"{n} map<string, string>" for n in ("models", "modelCosts", "providers")], *[f"{n} boolean" for n in ("archived", "deleted", "sourceDeleted")],
])


def normalized_sessions(records: DataFrame, column: str = "value", fallback: str = "fallback") -> DataFrame:
    """Sessions with a tool and an id, the other columns beside them (C4). Each text is parsed once.

    Without an id of its own a session takes that of the fallback column. A total that is not sent is the sum of input, output and cache; reasoning is part of
    output. Sessions of the tool that keeps its own sidecars are read from those, and dropped here.
    """
    rest = [c for c in records.columns if c not in (column, fallback)]
    v, t = F.col("_v"), F.col("_t")
    rows = _once(records.select(F.struct(*rest).alias("_o"), F.col(fallback).alias("_f"), F.col(column).alias("_j")), "_v", F.from_json("_j", _SESSION)).drop("_j")
    rows = _once(rows, "_t", F.struct(_first_text(*[v[a] for a in _CLIENTS]).alias("client"), _first_text(*[v[a] for a in TEXT_ALIASES["session"]], F.col("_f")).alias("session")))
    rows = rows.withColumns({"client": S.client_id(F.nullif(t["client"], F.lit(""))), "session": F.nullif(t["session"], F.lit(""))}).filter("client is not null and client <> 'reasonix' and session is not null")
    rows = rows.withColumns({c: S.whole(_first_number(v, ALIASES[c])) for c in (*_PARTS, "reasoning", "messages")})
    parts = sum((F.col(c) for c in _PARTS), F.lit(0))
    flags = F.coalesce(v["archived"], F.lit(False)) | F.coalesce(v["deleted"], F.lit(False)) | F.coalesce(v["sourceDeleted"], F.lit(False))
    rows = rows.withColumns({
        "total": S.whole(S.lenient_number(F.coalesce(*[v[a] for a in _TOTALS], parts.cast("string")))), "cost": S.lenient_number(F.coalesce(*[v[a] for a in _COSTS])),
        "started_at": _time(_first_text(*[v[a] for a in TEXT_ALIASES["started_at"]])), "last_used_at": _time(_first_text(*[v[a] for a in TEXT_ALIASES["last_used_at"]])),
        "project_id": _first_text(v["projectId"], v["project_id"]), "project_label": _first_text(v["projectLabel"], v["project_label"]),
        "models": v["models"], "model_costs": v["modelCosts"], "providers": v["providers"], "archived": flags,
    })
    count = lambda x: S.whole(S.lenient_number(x))
    model = lambda k: S.model_id(k, F.col("client"))
    rows = _summed(_summed(_summed(rows, "models", model, count), "model_costs", model, S.lenient_number), "providers", S.provider_id, count)
    return rows.select("_o.*", "client", "session", "total", *_PARTS, "reasoning", "cost", "messages", "started_at", "last_used_at", "project_id", "project_label", "models", "model_costs", "providers", "archived")


def _window_of(w: Column) -> Column:
    n = window_numbers(w["used"], w["limit"], w["remaining"], F.coalesce(*[w[c] for c in ("usedPercent", "used_percent", "utilization", "percent")]))
    label = F.trim(F.regexp_replace(F.regexp_replace(_trimmed(w["label"]), r"[^A-Za-z0-9 +._/-]", ""), r"\s+", " "))
    return F.struct(
        window_kind(F.coalesce(*[F.nullif(w[c], F.lit("")) for c in ("kind", "type", "name", "window", "windowKind")])).alias("kind"),
        _known(F.lower(_trimmed(w["metric"])), METRICS, None).alias("metric"), _known(F.lower(_trimmed(w["source"])), WINDOW_SOURCES, None).alias("source"),
        F.when(F.length(_trimmed(w["label"])) > 32, "").otherwise(label).alias("label"), *[n[c].alias(c) for c in ("used", "limit", "remaining", "used_percent", "remaining_percent")],
        _time(F.coalesce(*[w[c] for c in ("resetsAt", "resets_at", "resetAt", "reset_at")])).alias("resets_at"),
        S.quota_number(F.coalesce(*[w[c] for c in ("windowMinutes", "window_minutes", "windowDurationMins")])).alias("window_minutes"),
        F.nullif(F.substring(F.upper(_trimmed(w["currency"])), 1, 8), F.lit("")).alias("currency"),
        (~(F.coalesce(w["showMeter"] == "false", F.lit(False)) | F.coalesce(w["meter"] == "false", F.lit(False)))).alias("show_meter"),
    )


_WINDOW_FIELDS = "kind type name window windowKind metric source label used limit remaining usedPercent used_percent utilization percent resetsAt resets_at resetAt reset_at windowMinutes window_minutes windowDurationMins currency showMeter meter".split()
_READING = "windows array<struct<%s>>, balance struct<amount:string, currency:string, tranches:array<struct<amount:string, currency:string, expiresAt:string, expires_at:string>>>" % ", ".join(f"`{f}`:string" for f in _WINDOW_FIELDS)


def normalized_readings(records: DataFrame, column: str = "value") -> DataFrame:
    """Quota readings of known providers: texts within their lists, windows of known kinds in order, the balance with its grants by expiry.

    Windows are ordered session, weekly, billing, as sent within a kind; one provider's by model family first. A balance without a window of credits gets one.
    """
    v = F.col(column)
    provider = F.lower(_trimmed(_text(v, "provider")))
    read = F.col("_read")
    sent = F.filter(F.transform(F.coalesce(read["windows"], F.array().cast(f"array<struct<{', '.join(f'`{f}`:string' for f in _WINDOW_FIELDS)}>>")), _window_of), lambda w: w["kind"].isNotNull())
    low = lambda w: F.lower(w["label"])
    family = lambda w: F.when(provider != "antigravity", 0).when(low(w).contains("gemini"), 0).when(low(w).contains("claude") | low(w).contains("gpt"), 1).otherwise(2)
    rank = lambda w: F.array_position(F.array(*[F.lit(k) for k in WINDOW_ORDER]), w["kind"])
    ordered = F.transform(F.array_sort(F.transform(sent, lambda w, i: F.struct(family(w).alias("f"), rank(w).alias("r"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    currency = lambda c: F.nullif(F.substring(F.upper(_trimmed(c)), 1, 8), F.lit(""))
    tranche = lambda t: F.struct(S.quota_number(t["amount"]).alias("amount"), currency(t["currency"]).alias("currency"), _time(F.coalesce(t["expiresAt"], t["expires_at"])).alias("expires_at"))
    grants = F.filter(F.transform(read["balance"]["tranches"], tranche), lambda t: t["amount"].isNotNull())
    amount, none = S.quota_number(read["balance"]["amount"]), F.lit(None)
    restored = F.struct(
        F.lit("billing").alias("kind"), F.lit("credits").alias("metric"), none.cast("string").alias("source"), F.lit("Balance").alias("label"), none.cast("double").alias("used"), none.cast("double").alias("limit"),
        F.col("amount").alias("remaining"), none.cast("double").alias("used_percent"), none.cast("double").alias("remaining_percent"), none.cast("timestamp").alias("resets_at"), none.cast("double").alias("window_minutes"),
        F.col("currency").alias("currency"), F.lit(True).alias("show_meter"),
    )
    fields = {
        "provider": provider, "account_key": F.coalesce(_text(v, "accountKey"), F.lit("")), "account_label": S.account_label(_text(v, "accountLabel")), "plan_label": S.account_label(_text(v, "planLabel")),
        "account_name": S.account_name(_sent(v, "accountName", "accountLogin", "login")), "email": S.account_email(_sent(v, "accountEmail", "email")),
        "workspace_kind": F.when(F.lower(_trimmed(_text(v, "workspaceKind"))) == "personal", "personal").otherwise(""), "status": _known(_trimmed(_text(v, "status")), STATUSES, "error"),
        "source": _known(F.lower(_trimmed(_text(v, "source"))), SOURCES, ""), "source_detail": _known(F.lower(_trimmed(_sent(v, "sourceDetail", "source_detail"))), DETAILS, ""),
        "updated_at": F.coalesce(_time(_text(v, "updatedAt")), _time(_text(v, "checkedAt"))), "amount": amount, "currency": currency(read["balance"]["currency"]), "tranches": sorted_tranches(grants),
        "balance_usd": S.quota_number(_text(v, "balanceUsd")), "region": F.when(F.length(_trimmed(_text(v, "region"))) <= 16, F.lower(_trimmed(_text(v, "region")))).otherwise(""), "windows": ordered,
    }
    rest = [c for c in records.columns if c != column]
    parsed = _once(records, "_read", F.from_json(v, _READING))
    rows = _once(parsed, "_r", F.struct(*[c.alias(n) for n, c in fields.items()])).select(*rest, "_r.*").filter(F.col("provider").isin(*PROVIDERS))
    missing = F.col("amount").isNotNull() & ~F.exists("windows", lambda w: F.coalesce(w["metric"] == "credits", F.lit(False)))
    return rows.withColumn("windows", F.when(missing, F.concat("windows", F.array(restored))).otherwise(F.col("windows")))


_HEALTH = """source struct<checkedCount:string, detectedCount:string, checks:array<struct<id:string, exists:string>>>, collection struct<state:string, lastAttemptAt:string, lastSuccessAt:string>,
data struct<liveTokens:string, lastActivityDay:string>, diagnostics array<struct<code:string>>"""


def normalized_health(records: DataFrame, checks: Sequence[str], column: str = "value") -> DataFrame:
    """A tool's health with states that follow from its counts (C15): nothing in it contradicts anything else.

    Counts are at most MOST_CHECKS, and no more roots are found than looked for. `checks` are the ids that may be looked for; a list of checks that doesn't
    give the counts goes, as do diagnostics that the rest doesn't bear out and all after the first MOST_DIAGNOSTICS.
    """
    h = F.col("_sent")
    count = lambda x: F.least(F.lit(MOST_CHECKS), F.floor(F.greatest(F.lit(0.0), F.coalesce(F.nullif(x.try_cast("double"), F.lit(float("nan"))), F.lit(0.0))))).cast("int")
    checked = count(h["source"]["checkedCount"])
    detected = F.least(count(h["source"]["detectedCount"]), checked)
    state = _known(_trimmed(h["collection"]["state"]), COLLECTION, "unknown")
    live = F.greatest(F.lit(0.0), F.coalesce(h["data"]["liveTokens"].try_cast("double"), F.lit(0.0)))
    origin = F.when(checked == 0, "unknown").when(detected > 0, "detected").otherwise("missing")
    named = F.filter(F.transform(h["source"]["checks"], lambda c: F.struct(_trimmed(c["id"]).alias("id"), F.coalesce(c["exists"] == "true", F.lit(False)).alias("exists"))), lambda c: c["id"].isin(*checks))
    once = F.slice(F.filter(named, lambda c, i: ~F.exists(F.slice(named, F.lit(1), i), lambda d: d["id"] == c["id"])), 1, MOST_CHECKS)
    agree = (F.size(once) > 0) & (F.size(once) == checked) & (F.size(F.filter(once, lambda c: c["exists"])) == detected)
    borne = lambda c: F.when(c.startswith("sync-"), state == "failed").when(c == "source-missing", origin == "missing").when(c == "no-usage-observed", (origin == "detected") & (live == 0)).otherwise(True)
    codes = F.array_distinct(F.filter(F.transform(h["diagnostics"], lambda d: _trimmed(d["code"])), lambda c: c.isin(*DIAGNOSTICS) & borne(c)))
    day = S.strict_day(F.substring(_trimmed(h["data"]["lastActivityDay"]), 1, 10))
    fields = {
        "source": origin, "detected": detected, "checked": checked, "checks": F.when(agree, once), "collection": state, "last_attempt_at": _time(h["collection"]["lastAttemptAt"]),
        "last_success_at": _time(h["collection"]["lastSuccessAt"]), "live_tokens": live, "last_activity_day": day, "diagnostics": F.slice(F.coalesce(codes, F.array().cast("array<string>")), 1, MOST_DIAGNOSTICS),
        "overall": S.overall_health(origin, state, live),
    }
    rest = [c for c in records.columns if c != column]
    parsed = _once(records.filter(F.json_object_keys(column).isNotNull()), "_sent", F.from_json(column, _HEALTH))
    return _once(parsed, "_h", F.struct(*[c.alias(n) for n, c in fields.items()])).select(*rest, "_h.*")


def normalized_devices(records: DataFrame, now: Column, column: str = "value") -> DataFrame:
    """Devices' records with the fields that are known, and what each says of its history: 'off' if it is null, 'sent', or null if it says nothing.

    A day's and month's windows need an end; a time zone counts if it is one. Sessions and projects left out are counts over 0. Fields that are not sent are null, but
    the times, which are now.
    """
    v = F.col(column)
    keys = F.json_object_keys(v)
    has = lambda name: F.array_contains(keys, name)
    known = F.from_json(v, "projectsEnabled boolean, allTimeProjectsOmitted boolean, allTimeProjectsIncomplete boolean, historyAvailable boolean")
    flag = lambda name, default: F.when(has(name), F.coalesce(known[name], F.lit(default)))
    left_out = lambda name: F.nullif(S.whole(S.lenient_number(_text(v, name))), F.lit(0))
    ends = {p: _time(_text(v, f"periodWindows.{p}.endsAt")) for p in ("today", "month")}
    zone = F.substring(_trimmed(_text(v, "periodWindows.timeZone")), 1, 128)
    zoned = (ends["today"].isNotNull() | ends["month"].isNotNull()) & (zone != "") & F.concat(F.lit("2024-01-01 00:00:00 "), zone).try_cast("timestamp").isNotNull()
    interval = _text(v, "syncUploadIntervalMs").try_cast("double")
    plain = lambda name: F.coalesce(_text(v, name), F.lit(""))
    fields = {
        "device": F.coalesce(*[F.nullif(_text(v, n), F.lit("")) for n in ("deviceId", "id")], F.lit("unknown")), "hostname": plain("hostname"), "platform": plain("platform"),
        "agent_version": plain("agentVersion"), "agent_runtime": plain("agentRuntime"), "updated_at": F.coalesce(_time(_text(v, "updatedAt")), now), "received_at": F.coalesce(_time(_text(v, "receivedAt")), now),
        "os_name": F.when(has("osName"), F.substring(_trimmed(_text(v, "osName")), 1, 64)), "os_version": F.when(has("osVersion"), F.substring(_trimmed(_text(v, "osVersion")), 1, 128)),
        "tracked": F.when(has("trackedClients"), tracked_clients(_text(v, "trackedClients"))), "projects_enabled": flag("projectsEnabled", True), "all_time_projects_omitted": flag("allTimeProjectsOmitted", False),
        "all_time_projects_incomplete": flag("allTimeProjectsIncomplete", False), "history_available": flag("historyAvailable", False),
        **{f"{c}_omitted_{p}": left_out(f"{name}.{p}") for c, name in (("sessions", "sessionDetailsOmitted"), ("projects", "periodProjectsOmitted")) for p in ("today", "month")},
        "upload_ms": F.when(has("syncUploadIntervalMs"), F.when(interval.isin(*[float(x) for x in UPLOAD_INTERVALS_MS]), interval.cast("long")).otherwise(F.lit(0))),
        "history": F.when(has("history"), F.when(_text(v, "history").isNull(), "off").otherwise("sent")),
        **{f"{p}_ends_at": e for p, e in ends.items()}, **{f"{p}_key": F.when(e.isNotNull(), F.nullif(_text(v, f"periodWindows.{p}.key"), F.lit(""))) for p, e in ends.items()}, "time_zone": F.when(zoned, zone),
    }
    rest = [c for c in records.columns if c != column]
    return _once(records.filter(keys.isNotNull()), "_d", F.struct(*[c.alias(n) for n, c in fields.items()])).select(*rest, "_d.*")


def tracked_clients(value: Column) -> Column:
    """The ids of tools, each once, from a JSON list or text with commas."""
    listed = F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<string>"), F.split(F.coalesce(value, F.lit("")), ","))
    return F.array_distinct(F.filter(F.transform(listed, lambda c: S.client_id(c)), lambda c: c.isNotNull()))


def live_rows(live: DataFrame, previous: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """A live period's rows as a day's rows: components closed over each total, messages from the row that was there (C17).

    Rows: the keys, kind (total, client or model), name, tokens, cost, cache_read, cache_write, output, unclassified, exact; nulls count as 0. Without an exact split the
    rest is unclassified, or as much of it as the period says, if it says so of any row of the kind. `previous` has the keys, kind, name and messages, once each.
    """
    said = F.max(F.col("unclassified").isNotNull()).over(Window.partitionBy(*keys, "kind"))
    number = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    exact = F.coalesce(F.col("exact"), F.lit(False))
    given = F.when(exact, F.lit(0)).when(said, number("unclassified"))
    parts = closed_components(number("tokens"), F.col("cache_read"), F.col("cache_write"), F.col("output"), given, exact)
    rows = live.withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "cost": F.coalesce("cost", F.lit(0)), **{c: parts[c] for c in ("cache_read", "cache_write", "output", "unclassified")}, "exact": exact})
    return rows.join(previous.select(*keys, "kind", "name", "messages"), [*keys, "kind", "name"], "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def native_view(entries: DataFrame, now: Column, zone: str = "UTC", since: Column | None = None) -> DataFrame:
    """Each session's newest entry in the periods of its last activity: today, month, and all time if it was made since a day.

    Entries: session, seq, created_at, last_message_at, last_used_at, started_at and others; of entries used at one time the last counts. Tokens are known for the whole
    session only, so `reliable` says whether all of them fall into the period. Sessions without a time of creation are in no period.
    """
    used = F.coalesce(F.col("last_used_at"), F.col("started_at"), F.timestamp_seconds(F.lit(0)))
    rest = [c for c in entries.columns if c != "session"]
    newest = entries.groupBy("session").agg(F.max_by(F.struct(*rest), F.struct(used, F.col("seq"))).alias("e")).select("session", "e.*").filter("created_at is not null")
    made, active, today = (S.local_day(t, zone) for t in (F.col("created_at"), F.coalesce("last_message_at", "created_at"), now))
    month = lambda day: F.trunc(day, "month")
    period = lambda name, inside, reliable: F.when(inside, F.struct(F.lit(name).alias("period"), reliable.alias("reliable")))
    found = F.array(
        period("today", active == today, made == active), period("month", month(active) == month(today), month(made) == month(active)),
        period("all_time", F.lit(True) if since is None else F.coalesce(made >= since, F.lit(False)), F.lit(True)),
    )
    return newest.withColumn("_p", F.explode(F.array_compact(found))).select("*", "_p.period", "_p.reliable").drop("_p")


def native_projects(view: DataFrame) -> DataFrame:
    """Tokens and sessions of each project in a period, of the sessions whose tokens are known to fall into it."""
    counted = view.filter(F.col("reliable") & F.col("project_label").isNotNull() & F.col("total").isNotNull())
    tokens = F.greatest(F.lit(0), F.col("total"))
    return counted.groupBy("period", S.project_key(F.col("project_label")).alias("project")).agg(F.sum(tokens).cast("long").alias("tokens"), F.count_if(tokens > 0).alias("sessions"))


def displayed_readings(readings: DataFrame, local_limits: bool = False) -> DataFrame:
    """Readings without what one provider only estimates on this device, unless that is asked for.

    Readings: provider, local (is it of this device), source, source_detail, status, stale, account_key, web_account_key, windows (with source), amount, balance_usd. A window
    without a source of its own is local, but where the reading is marked as managed and comes from the web. What is left counts as read from the web; a reading of which
    nothing is left is disabled.
    """
    if local_limits:
        return readings
    name = lambda c: F.lower(_trimmed(c))
    trusted = (name(F.col("source_detail")) == "managed") & name(F.col("source")).isin("web", "api")
    readings = readings.withColumn("_trusted", F.coalesce(trusted, F.lit(False)))  # a column of its own: in a function on elements, names would mean the columns that are set below
    remote = F.filter("windows", lambda w: F.when(name(w["source"]) != "", name(w["source"]) == "web").otherwise(F.col("_trusted")))
    balance = F.col("amount").isNotNull() | F.col("balance_usd").isNotNull()
    touched = (name(F.col("provider")) == "opencode") & F.coalesce("local", F.lit(False)) & ((F.coalesce(F.size("windows"), F.lit(0)) > 0) | balance)
    any_left = (F.size(remote) > 0) | balance
    whole = any_left & (F.size(remote) == F.size("windows")) & name(F.col("source")).isin("web", "api")
    changed, gone = touched & ~F.coalesce(whole, F.lit(False)), touched & ~F.coalesce(any_left, F.lit(False))
    put = {
        "account_key": F.when(gone, F.col("account_key")).when(changed, F.coalesce("web_account_key", F.lit(""))).otherwise(F.col("account_key")), "source": F.when(changed & ~gone, "web").otherwise(F.col("source")),
        "windows": F.when(changed, remote).otherwise(F.col("windows")), "status": F.when(gone, "disabled").otherwise(F.col("status")), "stale": F.when(gone, False).otherwise(F.col("stale")),
    }
    return readings.withColumns(put).drop("_trusted")
