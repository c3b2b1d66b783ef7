"""Answers of every quota provider as windows (O1 to O21), one query a provider: an answer a supplier, with numbers x (0 to 100) and y (1 to 7) in it, and the SQL of the windows that it must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import quota_adapters
from ..sources.views import table
from .usage_queries import ORACLE_SQL, QUERIES

_X, _Y, _PART = "CAST(x AS DOUBLE)", "CAST(y AS DOUBLE)", "least(CAST(100 AS DOUBLE), CAST(x AS DOUBLE) / 80 * 100)"
_NONE, _LEFT = "CAST(NULL AS DOUBLE)", "greatest(CAST(0 AS DOUBLE), 80 - CAST(x AS DOUBLE))"
_ZAI = '{"data":{"limits":[{"type":"TOKENS_LIMIT","unit":6,"number":1,"percentage":{x}},{"type":"tokens_limit","unit":3,"number":5,"percentage":{y}},{"type":"TIME_LIMIT","unit":5,"number":1,"percentage":{x},"remaining":{y}},{"type":"ODD","percentage":1}]}}'
_ZAI_WINDOWS = [("session", "5-hour", _Y, _NONE, "true"), ("weekly", "Weekly", _X, _NONE, "true"), ("billing", "MCP", _X, _Y, "true")]

#: Of each provider the answer, and its windows: kind, label, percentage used, what remains, and when there is such a window.
ANSWERS = {
    "claude": (
        '{"five_hour":{"utilization":{x},"resets_at":"2026-01-01T00:00:00Z"},"sevenDay":{"utilization":"{y}%"},"limits":[{"kind":"odd","percent":1},{"kind":"weekly_scoped","scope":{"model":{"display_name":"Fable"}},"percent":{x}}],"spend":{"enabled":true,"used":{"amount_minor":{x},"exponent":0},"limit":{"amount_minor":8000,"exponent":2}}}',
        [("session", None, _X, _NONE, "true"), ("weekly", None, _Y, _NONE, "true"), ("weekly", "Fable", _X, _NONE, "true"), ("billing", "Usage credits", _PART, _NONE, "true")],
    ),
    "claude_text": ("Current session\n {x}% left\nCurrent week (all models) {y}.5% left", [("session", None, f"100 - {_X}", _NONE, "true"), ("weekly", None, f"99.5::DOUBLE - {_Y}", _NONE, "true")]),
    "codex": ('{"rate_limits":{"primary":{"used_percent":{x},"window_duration_mins":300},"secondary":{"usedPercent":{y},"windowDurationMins":43200}}}', [("session", None, _X, _NONE, "true"), ("billing", "Monthly", _Y, _NONE, "true")]),
    "cursor": ('{"requests":{"used":{x},"limit":80},"plan":{"autoPercentUsed":{y}}}', [("billing", "Total", _PART, _LEFT, "true"), ("billing", "Auto", _Y, _NONE, "true")]),
    "antigravity": (
        '{"response":{"groups":[{"displayName":"Gemini","buckets":[{"window":"5h","remainingFraction":0.{y}},{"window":"WEEKLY","remainingFraction":0.5,"disabled":true},{"window":"odd"}]}]}}',
        [("session", "Gemini 5-hour", "100 - CAST('0.' || y AS DOUBLE) * 100", _NONE, "true"), ("weekly", "Gemini weekly", _NONE, _NONE, "true")],
    ),
    "opencode": ('{"web":{"rolling":{"usagePercent":{x}},"monthly":{"usagePercent":{x}}},"go":{"rolling":{"usagePercent":{y}}},"zen":{"balance":{x}}}', [("session", None, _Y, _NONE, "true"), ("billing", None, _X, _NONE, "true"), ("billing", "Zen", _NONE, _X, "true")]),
    "openrouter": (
        '{"data":{"limit":80,"limit_remaining":{x},"limit_reset":" Daily"},"credits":{"total_credits":20,"total_usage":{y}}}',
        [("session", "Daily limit", f"greatest(CAST(0 AS DOUBLE), 80 - {_X}) / 80 * 100", _X, "true"), ("billing", "Credits", f"{_Y} / 20 * 100", f"20 - {_Y}", "true")],
    ),
    "deepseek": ('{"balance_infos":[{"total_balance":"{x}.5"}],"month_spend":{y}}', [("billing", "Balance", f"{_Y} / ({_X} + 0.5::DOUBLE + {_Y}) * 100", f"{_X} + 0.5::DOUBLE", "true")]),
    "minimax": ('{"current_interval_remaining_percent":"{x}","current_interval_status":1,"current_weekly_remaining_percent":"{x}","current_weekly_status":3}', [("session", "5h", f"100 - {_X}", _NONE, "true"), ("weekly", "Weekly", f"100 - {_X}", _NONE, "x < 100")]),
    "mimo": ('{"data":{"monthUsage":{"used":1,"limit":2,"items":[{"name":"Month_Total_Token","used":{x},"limit":80}]},"balance":{y}}}', [("billing", "Token plan", _PART, _LEFT, "true"), ("billing", "Balance", _NONE, _Y, "true")]),
    "grok": ('{"config":{"used":{x},"monthlyLimit":80,"billingPeriodStart":"2026-01-01T00:00:00Z","billingPeriodEnd":"2026-02-01T00:00:00Z"}}', [("billing", "Monthly", _PART, _NONE, "true")]),
    "copilot": ('{"quota_snapshots":{"premium":{"percent_remaining":{x}}},"chat":{"percentRemaining":{y}}}', [("billing", "Premium", f"100 - {_X}", _NONE, "true"), ("billing", "Chat", f"100 - {_Y}", _NONE, "true")]),
    "kiro": ("Credits: {x} / 80\nBonus credits {y} of 40, expires in 5 days\nOverages: 3", [("billing", "Credits", _PART, _NONE, "true"), ("billing", "Bonus", f"{_Y} / 40 * 100", _NONE, "true"), ("billing", "Overage", _NONE, _NONE, "true")]),
    "zai": (_ZAI, _ZAI_WINDOWS),
    "zaiteam": (_ZAI, _ZAI_WINDOWS),
    "volcengine": ('{"Result":{"Quotas":[{"Level":" 5H","Percent":{x}},{"Level":"month","Percent":{y}},{"Level":"other","Percent":3},{"Level":"week"}]}}', [("session", "5-hour", _X, _NONE, "true"), ("billing", "Monthly", _Y, _NONE, "true")]),
    "commandcode": (
        '{"credits":{"monthlyCredits":{y},"purchasedCredits":{x},"windowLimits":{"fiveHour":{"used":{x},"cap":80},"weekly":{"used":1,"cap":0}}}}',
        [("session", None, _PART, _LEFT, "true"), ("billing", "Monthly", _NONE, _Y, "true"), ("billing", "Top-up", _NONE, _X, "x > 0")],
    ),
    "qoder": ('{"data":{"totalQuota":{"quotaSummary":{"usedValue":{x},"limitValue":40}},"sharedQuota":{"quotaSummary":{"usedValue":{y},"limitValue":40,"remainingValue":3}}}}', [("billing", "Credits", f"least(CAST(100 AS DOUBLE), ({_X} + {_Y}) / 80 * 100)", f"greatest(CAST(0 AS DOUBLE), 40 - {_X}) + 3", "true")]),
    "ollama": ("<b>Session usage</b> {x}.5% used <b>Weekly usage</b> {y}% used", [("session", None, f"least(CAST(100 AS DOUBLE), {_X} + 0.5::DOUBLE)", _NONE, "true"), ("weekly", None, _Y, _NONE, "true")]),
    "kimi": ('{"rateLimit5h":{"ratio":0.{y}},"session":{"usedRatio":1},"weekly":{"usedRatio":{x}}}', [("session", "5-hour", "CAST('0.' || y AS DOUBLE) * 100", _NONE, "true"), ("weekly", "Weekly", f"least(CAST(100 AS DOUBLE), {_X} * 100)", _NONE, "true")]),
    "thirdparty": ('{"label":"Key","remaining":{x},"used":{y}}', [("billing", "Key", f"{_Y} / ({_X} + {_Y}) * 100", _X, "true")]),
}


def _register(provider: str, answer: str, expected: list) -> None:
    def windows(spark, d):
        key = F.col("s_suppkey")
        filled = F.replace(F.replace(F.lit(answer), F.lit("{x}"), (key % 101).cast("string")), F.lit("{y}"), (key % 7 + 1).cast("string"))
        rows = table(spark, d, "supplier").select(key.alias("row"), filled.alias("body"))
        return quota_adapters.quota_windows(rows, provider).select("row", "kind", "label", "used_percent", "remaining")

    part = lambda kind, label, percent, left, when: f"SELECT row, '{kind}' AS kind, {f"'{label}'" if label else 'CAST(NULL AS VARCHAR)'} AS label, {percent} AS used_percent, {left} AS remaining FROM n WHERE {when}"
    name = f"quota_of_{provider}"
    QUERIES[name] = windows
    ORACLE_SQL[name] = "WITH n AS (SELECT s_suppkey AS row, s_suppkey % 101 AS x, s_suppkey % 7 + 1 AS y FROM supplier) " + " UNION ALL ".join(part(*e) for e in expected)


for _provider, (_answer, _expected) in ANSWERS.items():
    _register(_provider, _answer, _expected)
