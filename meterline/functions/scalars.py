"""Scalar functions of usage rows as Column expressions: numbers, names, dates, text and formats.

All are built-in expressions that stay inside code generation; none is a Python function on rows. Nulls give the documented default.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of a raw tool name, in the order in which they win, and the tool's id.
CLIENT_RULES = [
    ("claude", "claude"), ("codex", "codex"), ("hermes", "hermes"), ("gemini", "gemini"), ("cursor", "cursor"), ("antigravity", "antigravity"),
    ("kimi", "kimi"), ("qwen", "qwen"), ("grok", "grok"), ("copilot", "copilot"), (r"\bpi\b", "pi"), ("zed", "zed"), ("kilocode", "kilocode"),
    (r"command[\s_-]*code", "commandcode"), ("micode", "micode"), ("zcode", "zcode"), ("kiro", "kiro"), ("codebuddy", "codebuddy"),
    ("workbuddy", "workbuddy"), ("proma", "proma"), ("qodercn|^qoder[ -]cn$", "qodercn"), ("reasonix", "reasonix"), ("opencode", "opencode"),
    ("openclaw|clawd|moltbot|moldbot", "openclaw"),
]
# Patterns of model names, in the order in which they win, and the vendor.
VENDOR_RULES = [
    ("^(cursor-)?auto$", "cursor"), ("claude|anthropic|sonnet|opus|haiku", "claude"), ("gpt|openai|codex|^o[134](-|$)|o[134]-(mini|pro|preview)|chatgpt", "codex"),
    ("gemini|gemma|google", "gemini"), ("grok|xai", "xai"), ("deepseek", "deepseek"), ("llama|meta", "meta"), ("mistral|mixtral|codestral", "mistral"),
    ("qwen|qwq|qvq", "qwen"), ("kimi|moonshot", "kimi"), (r"chatglm|\bglm-|\bzai\b|z\.ai|zhipu", "zai"), ("cohere|command-r", "cohere"),
    ("mimo|xiaomi", "xiaomi"), (r"minimax|\babab", "minimax"), (r"doubao|\bseed(-|$)", "doubao"), ("hy3|hunyuan", "hunyuan"), ("^big-pickle$", "opencode"),
]


def at_least(x: Column, floor: float = 0.0) -> Column:
    """The larger one; null stays null, which greatest() alone would drop."""
    return F.when(x.isNotNull(), F.greatest(F.lit(floor), x))


def percent(x: Column) -> Column:
    """A percentage from 0 to 100; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def lenient_number(value: Column) -> Column:
    """A number from text with $ and , taken out; 0 for anything else."""
    number = F.regexp_replace(F.trim(value.cast("string")), "[$,]", "").try_cast("double")
    return F.coalesce(F.when(F.abs(number) < float("inf"), number), F.lit(0.0))


def quota_number(value: Column) -> Column:
    """As lenient_number, with % taken out too, and null for anything else."""
    number = F.regexp_replace(F.trim(value.cast("string")), "[$,%]", "").try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def first_number(*values: Column) -> Column:
    """The first value that is a number other than 0, or 0."""
    return F.coalesce(*[F.nullif(lenient_number(v), F.lit(0.0)) for v in values], F.lit(0.0))


def first_text(*values: Column) -> Column:
    """The first value that is not blank, trimmed, or '' (J2)."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values], F.lit(""))


def whole(value: Column) -> Column:
    """A count: half rounds up, never negative (S: long counters)."""
    return F.greatest(F.lit(0), F.floor(value + 0.5)).cast("long")


def slug(value: Column) -> Column:
    """Lower case, other characters as one - each run, none at the ends; null if nothing is left."""
    dashed = F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9_-]+", "-")
    return F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(""))


def client_id(value: Column) -> Column:
    """The id of a tool by the first rule that its name meets, else its slug."""
    raw = F.lower(F.trim(value))
    out = F.when(raw.rlike(CLIENT_RULES[0][0]), CLIENT_RULES[0][1])
    for pattern, name in CLIENT_RULES[1:]:
        out = out.when(raw.rlike(pattern), name)
    return out.otherwise(slug(value))


def provider_id(value: Column) -> Column:
    """A provider's slug; dashes at the ends stay."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9_-]+", "-"), F.lit(""))


def model_id(model: Column, client: Column) -> Column:
    """Lower-cased model; one tool's vendor prefix goes, another's auto mode gets its name."""
    low = F.nullif(F.lower(F.trim(model)), F.lit(""))
    return F.when((client == "reasonix") & low.rlike("^(deepseek|deepseek-flash)/."), F.regexp_replace(low, "^(deepseek|deepseek-flash)/", "")).when((client == "cursor") & (low == "auto"), "cursor-auto").otherwise(low)


def model_vendor(model: Column) -> Column:
    """The vendor by the first pattern that matches, or null."""
    low = F.lower(F.coalesce(model, F.lit("")))
    out = F.when(low.rlike(VENDOR_RULES[0][0]), VENDOR_RULES[0][1])
    for pattern, vendor in VENDOR_RULES[1:]:
        out = out.when(low.rlike(pattern), vendor)
    return out


def project_path(path: Column) -> Column:
    """One kind of slash, a small drive letter, no slash at the end."""
    one = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    drive = F.when(one.rlike("^[A-Z]:"), F.concat(F.lower(F.substring(one, 1, 1)), F.substring(one, 2, 1 << 20))).otherwise(one)
    return F.when(F.length(drive) > 1, F.regexp_replace(drive, "/+$", "")).otherwise(drive)


def project_identity(path: Column) -> Column:
    """A short stable hash of a normalized path."""
    return F.substring(F.sha2(F.concat(project_path(path), F.lit("\0")), 256), 1, 16)


def project_key(label: Column) -> Column:
    """The canonical key of an ASCII label; other labels go through nfc_key."""
    return F.nullif(F.lower(F.trim(label)), F.lit(""))


def nfc_key(label: Column) -> Column:
    """The canonical key of any label: NFC needs a pandas function, so ASCII labels don't pass through it."""
    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFC", x.strip()).lower()) if x is not None else None)

    return F.when(label.rlike(r"^[\x00-\x7F]*$"), project_key(label)).otherwise(F.nullif(nfc(label), F.lit("")))


def _form(value: Column, form: str) -> Column:
    """A Unicode normal form; it needs a pandas function, so ASCII text doesn't pass through it."""
    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda x: unicodedata.normalize(form, x) if x is not None else None)

    return F.when(value.rlike(r"^[\x00-\x7F]*$"), value).otherwise(apply(value))


# How long account labels and names may be, as they come and when they are clean.
LABEL_MOST, NAME_MOST = (256, 32), (512, 64)


def _account_text(value: Column, marks: str, most: tuple[int, int]) -> Column:
    raw = F.trim(F.coalesce(value, F.lit("")))
    clean = F.trim(F.regexp_replace(F.regexp_replace(_form(raw, "NFC"), rf"[^\p{{L}}\p{{M}}\p{{N}} {marks}]", ""), r"\s+", " "))
    told = _form(raw, "NFKC").rlike("(?i)@|https?://")
    return F.when((F.length(raw) > most[0]) | told | (F.length(clean) > most[1]), "").otherwise(clean)


def account_label(value: Column) -> Column:
    """A label of an account or plan without odd characters; '' if it holds an address or a link, or is too long."""
    return _account_text(value, "+._-", LABEL_MOST)


def account_name(value: Column) -> Column:
    """A person's or login's name by the same rules."""
    return _account_text(value, "._-", NAME_MOST)


def account_email(value: Column) -> Column:
    """A plain e-mail address in lower case, or '' (C12)."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when((F.length(low) <= 254) & low.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), low).otherwise("")


def masked_email(value: Column) -> Column:
    """First and last character of the local part, the rest as three stars."""
    email = F.trim(value)
    local, domain = F.regexp_extract(email, r"(?s)^(.+)@[^@]+$", 1), F.regexp_extract(email, r"(?s)^.+@([^@]+)$", 1)
    last = F.when(F.length(local) > 1, F.right(local, F.lit(1))).otherwise("")
    return F.when(local == "", email).otherwise(F.concat(F.left(local, F.lit(1)), F.lit("***"), last, F.lit("@"), domain))


def strict_day(value: Column) -> Column:
    """A date from text of the form YYYY-MM-DD that names a real day, else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def local_day(ts: Column, zone: Column | str) -> Column:
    """The calendar day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def instant(value: Column) -> Column:
    """A timestamp from epoch seconds or milliseconds: below 2e10 are seconds (types, J14)."""
    return F.when(value < 20_000_000_000, F.timestamp_seconds(value)).otherwise(F.timestamp_millis(value.cast("long")))


def day_end(day: Column, zone: Column | str) -> Column:
    """The instant at which a local day ends."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def month_end(day: Column, zone: Column | str) -> Column:
    """The instant at which a local day's month ends."""
    return F.to_utc_timestamp(F.add_months(F.trunc(day, "month"), 1).cast("timestamp"), zone)


def week_start(day: Column, first: int = 0) -> Column:
    """The first day of a week that begins on weekday `first` (0 is Monday)."""
    return F.date_sub(day, F.pmod(F.weekday(day) - first, F.lit(7)))


def anchored_month(anchor: Column, n: Column) -> Column:
    """The anchor n months later, on its own day or the month's last."""
    return F.add_months(anchor, n)


def intensity(value: Column, most: Column) -> Column:
    """0 to 4 by the share of the largest value: from 3/4, 1/2, 1/4, above 0."""
    share = F.when(most > 0, value / most).otherwise(0.0)
    return F.when(value <= 0, 0).when(share >= 0.75, 4).when(share >= 0.5, 3).when(share >= 0.25, 2).when(share > 0, 1).otherwise(0)


def widget_intensity(value: Column, most: Column) -> Column:
    """The other formula: the share in quarters, rounded up."""
    return F.when((most > 0) & (value > 0), F.least(F.lit(4), F.ceil(value / most * 4))).otherwise(0).cast("int")


def rounded(value: Column, places: int) -> Column:
    return F.round(value, places)


def convert_usd(value: Column, rate: Column) -> Column:
    """Dollars at a rate, to six places."""
    return F.round(value * F.coalesce(rate, F.lit(1.0)), 6)


# Divisors and signs of compact numbers.
COMPACT_UNITS = {"western": [(1e9, "B"), (1e6, "M"), (1e3, "K")], "zh-hans": [(1e8, "亿"), (1e4, "万")], "zh-hant": [(1e8, "億"), (1e4, "萬")], "ja": [(1e8, "億"), (1e4, "万")], "ko": [(1e8, "억"), (1e4, "만")]}


def compact(value: Column, units: str = "western") -> Column:
    """A count with a unit sign: one digit after the point (two below 10 in localized units), no zeros at the end, the next unit where rounding reaches it (J21). Ties round up."""
    steps = COMPACT_UNITS[units]
    number = F.floor(value + 0.5).cast("double")
    bound = steps[0][0] / steps[1][0]
    out = None
    for i, (size, sign) in enumerate(steps):
        scaled = number / size
        digits = F.when(F.abs(scaled) < 10, F.format_string("%.2f", scaled)).otherwise(F.format_string("%.1f", scaled)) if units != "western" else F.format_string("%.1f", scaled)
        text = F.concat(F.regexp_replace(digits, r"\.?0+$", ""), F.lit(sign))
        enough = F.abs(number) >= size
        if i + 1 < len(steps):  # rounding in the lower unit reaches this one
            enough = enough | (F.abs(F.round(number / steps[i + 1][0], 1)) >= bound)
        out = F.when(enough, text) if out is None else out.when(enough, text)
    return out.otherwise(number.cast("long").cast("string"))


def duration(ms: Column) -> Column:
    """Hours and minutes, rounded to minutes."""
    minutes = F.greatest(F.lit(0), F.floor(F.coalesce(ms, F.lit(0)) / 60000 + 0.5)).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def stable_colour(value: Column, colours: int = 12) -> Column:
    """A colour number: the absolute value of a signed 32-bit hash with multiplier 31 over the characters' first UTF-16 units."""
    text = F.coalesce(value, F.lit(""))
    at = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        point = F.ascii(F.substring(text, i, F.lit(1))).cast("long")
        unit = F.when(point > 0xFFFF, F.shiftright(point, 10) + 0xD7C0).otherwise(point)
        return F.pmod(h * 31 + unit + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)

    return (F.abs(F.aggregate(at, F.lit(0).cast("long"), step)) % colours).cast("int")


def prompt_text(value: Column) -> Column:
    """A prompt without image references, its white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"\[Image[^\]]*\]|<image[^>]*>", " "), r"\s+", " "))


def session_label(value: Column) -> Column:
    """A session id without its rollout prefix; '' where only a timestamp is left."""
    bare = F.regexp_replace(F.trim(value), r"^rollout-\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-", "")
    return F.when(bare.rlike(r"^(rollout-)?\d{4}-\d{2}-\d{2}T[\d-]+$"), "").otherwise(bare)


def session_time(value: Column) -> Column:
    """The instant inside a session id, or null."""
    found = F.regexp_extract(value, r"(\d{4}-\d{2}-\d{2})T(\d{2})[-:](\d{2})[-:](\d{2})", 0)
    parts = F.regexp_replace(found, r"T(\d{2})[-:](\d{2})[-:](\d{2})", " $1:$2:$3")
    return F.try_to_timestamp(parts, F.lit("yyyy-MM-dd HH:mm:ss"))


def model_label(models: Column) -> Column:
    """No model, its name, or how many (J28); models maps a name to tokens."""
    names = F.map_keys(F.map_filter(models, lambda _, tokens: tokens > 0))
    return F.when(F.size(names) == 0, "").when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.size(names).cast("string"), F.lit(" models")))


def quota_percent(funds: Column, spent: Column) -> Column:
    """What is left of a credits meter: funds of funds and spending."""
    return F.when(funds + spent > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), funds / (funds + spent) * 100)))


MOST_RETRY_AFTER_MS, RETRY_JITTER_MS, RETRY_BASE_MS, RETRY_MOST_MS = 3_600_000, 5_000, 5_000, 300_000


def retry_delay(value: Column, now: Column) -> Column:
    """Milliseconds from a Retry-After header, seconds or an HTTP date, from 0 to an hour; null for anything else."""
    date = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ms = F.when(value.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(value).try_cast("double") * 1000).when(date.isNotNull(), (F.unix_millis(date) - F.unix_millis(now)).cast("double"))
    return F.when(ms.isNotNull(), F.least(F.lit(float(MOST_RETRY_AFTER_MS)), F.greatest(F.lit(0.0), ms))).cast("long")


def backoff(attempt: Column, part: Column, retry_after_ms: Column | None = None, base_ms: int = RETRY_BASE_MS, most_ms: int = RETRY_MOST_MS) -> Column:
    """The delay before the next attempt (J30), rounded up; part is a number in [0, 1) that stands for chance.

    What the server asked for, with a tenth of it (5 seconds at most) as jitter; else half of the bound and as much of the other half as
    part says. The bound doubles with each attempt from the second on, up to most_ms.
    """
    exponent = F.greatest(F.lit(0), F.least(F.lit(30), F.floor(F.coalesce(F.nullif(attempt, F.lit(0)), F.lit(1))) - 1))
    bound = F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(2.0), exponent))
    own = F.ceil(bound / 2 + part * (bound / 2))
    if retry_after_ms is None:
        return own.cast("long")
    asked = F.least(F.lit(float(MOST_RETRY_AFTER_MS)), retry_after_ms)
    return F.when(retry_after_ms > 0, F.ceil(asked + part * F.least(F.lit(float(RETRY_JITTER_MS)), asked * 0.1))).otherwise(own).cast("long")


# Patterns of error messages in the order in which they win, the code of each, and the only tool to which it applies, if any. Of the
# patterns of one rule all must match.
ERROR_RULES = [
    ([r"permission denied|access is denied|operation not permitted|\beacces\b|\beperm\b"], "permission-denied", None),
    ([r"no space left on device|read-only file system|failed to (?:create|persist|write|save).*(?:cache|artifact|manifest)|(?:cache|artifact|manifest).*(?:write|persist|save).*(?:failed|error)"], "cache-write-failed", None),
    ([r"session (?:token )?(?:expired|invalid)|invalid (?:api )?token|not authenticated|re-authenticate|unauthorized|forbidden|status\s+(?:401|403)\b"], "authentication-failed", None),
    ([r"\b(?:etimedout|network|https?|request|connect(?:ion)?|socket|tcp|tls|dns)\b", r"\b(?:etimedout|timed out|timeout|deadline exceeded|deadline has elapsed)\b"], "network-timeout", None),
    ([r"malformed.*response|invalid response|expected csv format|failed to parse response|invalid json"], "invalid-response", None),
    ([r"cannot discover .*language servers?|language server.*(?:not found|unavailable)|no .*language servers?"], "language-server-not-found", "antigravity"),
    ([r"\brpc\b.*(?:fail|error)|(?:fail|error).*\brpc\b|failed to connect to antigravity rpc"], "rpc-failed", "antigravity"),
    ([r"failed to connect|connection refused|connection reset|could not resolve|\bdns\b|\bnetwork\b"], "network-failed", None),
]
MOST_ERROR_TEXT = 8 * 1024


def error_code(text: Column, client: Column | None = None) -> Column:
    """The code of an error message by the first rule that it meets, or null (J31). Some rules apply to one tool only."""
    low = F.lower(F.trim(F.substring(F.coalesce(text, F.lit("")), 1, MOST_ERROR_TEXT)))
    out = None
    for patterns, code, tool in ERROR_RULES:
        met = F.lit(True) if tool is None else F.coalesce((client if client is not None else F.lit("")) == tool, F.lit(False))
        for pattern in patterns:
            met = met & low.rlike(pattern)
        out = F.when(met, code) if out is None else out.when(met, code)
    return out


# The states of a tool's files and of their collection that say something, and of a tool on a device.
SOURCE_STATES, COLLECTION_STATES, CLIENT_STATES = ("detected", "missing"), ("direct", "idle", "pending", "ok", "failed"), ("active", "waiting", "missing")


def overall_health(source: Column, collection: Column, live_tokens: Column) -> Column:
    """One state of a tool from its files, their collection and its tokens (J32). A failure outranks missing files."""
    known = F.coalesce(source.isin(*SOURCE_STATES), F.lit(False)) & F.coalesce(collection.isin(*COLLECTION_STATES), F.lit(False))
    return F.when(~known, "unknown").when(collection == "failed", "attention").when(source == "missing", "unavailable").when(live_tokens > 0, "healthy").otherwise("waiting")


def known_states(states: Column) -> Column:
    """Of a map from tools to states, those with a known state, under the tools' ids, of spellings of one tool the least known state."""
    named = F.transform(F.map_entries(states), lambda e: F.struct(client_id(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.array_sort(F.filter(named, lambda e: e["key"].isNotNull() & F.coalesce(e["value"].isin(*CLIENT_STATES), F.lit(False))))
    first = F.filter(kept, lambda e, i: (i == 0) | (F.get(kept, i - 1)["key"] != e["key"]))
    return F.map_from_entries(first)


def utc_day(ts: Column) -> Column:
    """The UTC day of an instant, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))


def day_state(key: Column, ends_at: Column, zone: Column, now: Column) -> Column:
    """What day it is for a device, and of which day its numbers are (J13): before its day's end both are its day; after it, now's day in its zone; null if unknown."""
    day = strict_day(key)
    now_there = F.when(zone.isNotNull(), F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.unix_micros(now)), zone)))
    current = F.when(now < ends_at, day).otherwise(now_there)
    return F.when(day.isNotNull() & ends_at.isNotNull() & current.isNotNull(), F.struct(current.alias("current"), day.alias("snapshot")))


# Further ids that a tool's id admits.
CLIENT_ALIASES = {"antigravity": ["antigravity-cli"]}


def admitted_clients(ids: str) -> list[str]:
    """The ids of a comma-separated list in order, each once, with those that they admit behind them (A3)."""
    out: dict[str, None] = {}
    for one in filter(None, (x.strip() for x in ids.split(","))):
        out |= dict.fromkeys([one, *CLIENT_ALIASES.get(one, [])])
    return list(out)


def multiple(usage: Column, paid: Column) -> Column:
    """Usage for each unit paid, or null."""
    return F.when(paid > 0, usage / paid)


def content_print(*columns: Column) -> Column:
    """A hash of a row's content, equal for equal rows."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
