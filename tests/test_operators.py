"""Operators on small examples: closures, streaks, archives, deltas, quotas, prices, subscriptions, transcripts, sources, streams."""

import datetime as dt
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from meterline.operators import devices, export, history, identity, money, quota, records, rollup, transcripts
from meterline.sources import files, quota_adapters
from meterline.streaming import streams

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components_close_over_the_total(spark):
    df = spark.createDataFrame([(100, 60, 5, 10, True), (100, 90, 20, 30, True), (100, 10, 5, 5, False), (0, 5, 5, 5, True)], "t long, r long, w long, o long, e boolean")
    closed = rollup.closed_components(*[F.col(c) for c in "trwo"], F.lit(None).cast("long"), F.col("e"))
    out = [tuple(r) for r in df.select(*[closed[c] for c in ("cache_read", "cache_write", "output", "unclassified", "miss")]).collect()]
    assert out == [(60, 5, 10, 0, 25), (90, 10, 0, 0, 0), (10, 5, 5, 80, 0), (0, 0, 0, 0, 0)]


def test_streaks_end_today_or_are_none(spark):
    days = spark.createDataFrame([(D(2024, 1, d), t) for d, t in [(1, 5), (2, 5), (3, 5), (5, 5), (6, 0), (7, 5), (8, 5)]], "day date, tokens long")
    assert rows(history.streaks(days, "2024-01-08")) == [(2, 3)] and rows(history.streaks(days, "2024-01-09")) == [(0, 3)]
    filled = history.filled(days, "2024-01-01", "2024-01-08", ["tokens"])
    assert rows(history.trailing_streak(filled, "2024-01-08")) == [(2,)]
    assert [r["tokens"] for r in filled.orderBy("day").collect()] == [5, 5, 5, 0, 5, 0, 5, 5]


def test_delta_equals_full_scan(spark):
    make = lambda x: spark.createDataFrame(x, "k string, v long")
    out = devices.apply_delta(make([("a", 10), ("b", 5)]), make([("a", 4), ("c", 2)]), make([("a", 1), ("b", 9)]), ["k"], ["v"])
    assert rows(out) == [("a", 13), ("b", 0), ("c", 2)]


def test_archive_never_shrinks_and_does_not_depend_on_order(spark):
    seen = [("d", "m", 10, 1, 1), ("d", "m", 10, 3, 2), ("d", "m", 9, 9, 3), ("d", "m", 10, 3, 4)]
    for some in (seen, seen[::-1]):
        df = spark.createDataFrame(some, "day string, model string, tokens long, messages long, batch long")
        assert rows(devices.archive(df, ["day", "model"])) == [("d", "m", 10, 3, 4)]


def test_upsert_tells_absent_from_null(spark):
    old = spark.createDataFrame([("a", "n", "h"), ("b", "n", "h"), ("c", "n", "h")], "device string, name string, history string")
    new = spark.createDataFrame([("a", "x", None, False), ("b", "x", None, True), ("d", "x", "y", True)], "device string, name string, history string, has_history boolean")
    assert rows(devices.upsert(old, new, "device", ["history"])) == [("a", "x", "h"), ("b", "x", None), ("c", "n", "h"), ("d", "x", "y")]


def test_expiry(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    now = ts("2024-01-30 12:00:00")
    cases = [(devices.is_open(now, ts("2024-01-30 12:00:00"), now, "today"), False), (devices.is_open(now, ts("2024-01-30 12:00:01"), now, "today"), True), (devices.is_open(now, ts(None), ts("2024-01-29 23:59:00"), "today"), False), (devices.is_open(now, ts(None), ts("2024-01-01 00:00:00"), "month"), True), (devices.is_open(now, ts(None), ts(None), "all_time"), True), (devices.is_plausible_day(F.lit("2024-01-31").cast("date"), now), True), (devices.is_plausible_day(F.lit("2024-01-29").cast("date"), now), False)]
    assert list(spark.range(1).select(*[c for c, _ in cases]).first()) == [w for _, w in cases]


def test_burn_rate_rises_at_once_and_falls_slowly(spark):
    samples = [("w", 0, 1, 10.0), ("w", 10, 2, 30.0), ("w", 20, 3, 31.0), ("w", 20, 4, 99.0), ("w", 30, 5, 5.0), ("v", 1, 1, 1.0)]
    df = spark.createDataFrame(samples, "window string, at long, seq long, used double")
    out = {r["window"]: r for r in quota.burn_rates(df, ["window"]).collect()}
    assert out["w"]["rate"] == pytest.approx(0.3 * 0.1 + 0.7 * 2.0) and out["w"]["used"] == 5.0 and out["v"]["rate"] == 0.0
    assert quota.urgency(quota.burn_rates(df, ["window"]), 0.0).count() == 1


def test_streaming_burn_state_equals_the_batch_fold(spark, sf_dir):
    from meterline.plans import stream_queries

    stream = streams.run_to_end(streams.burn_rates(stream_queries.burn_samples(spark, sf_dir)), "update", keys=["window"])
    got = {r["window"]: (r["at"], r["used"], round(r["rate"], 12)) for r in stream.collect()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = events.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("window"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.floor(F.col("value") * 100 + 0.5) % 100).alias("used"))
    assert got == {r["window"]: (r["at"], r["used"], round(r["rate"], 12)) for r in quota.burn_rates(samples, ["window"]).collect()}


def test_keyed_batches_merge_and_repeat_safely(spark, tmp_path):
    merge = streams.keep_latest(f"file://{tmp_path}/t", ["k"], "at")
    make = lambda x: spark.createDataFrame(x, "k string, at long, v long")
    merge(make([("a", 1, 1), ("b", 1, 1)]), 0)
    for _ in range(2):
        merge(make([("a", 2, 2), ("a", 3, 3), ("c", 0, 0)]), 1)
    assert rows(spark.read.parquet(f"{tmp_path}/t/v1")) == [("a", 3, 3), ("b", 1, 1), ("c", 0, 0)]


def test_streaming_burn_state_takes_frames_and_files_in_any_order(spark, tmp_path):
    from meterline.plans import stream_queries
    from meterline.sources.views import table

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_type", F.lit("view"))
    (tmp_path / "events.parquet").mkdir()
    for i, descending in enumerate((True, False)):  # two files of interleaved times, the first from new to old
        half = events.filter(F.col("event_id") % 2 == i).orderBy(F.col("ts").desc() if descending else "ts").toPandas()
        spark.createDataFrame(half, events.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        stream = streams.run_to_end(streams.burn_rates(stream_queries.burn_samples(spark, str(tmp_path))), "update", keys=["window"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    samples = table(spark, str(tmp_path), "events").select(F.concat(F.col("user_id").cast("string"), F.lit("|view")).alias("window"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.floor(F.col("value") * 100 + 0.5) % 100).cast("double").alias("used"))
    found = lambda rows: sorted((r["window"], r["at"], r["used"], round(r["rate"], 12)) for r in rows)
    assert found(stream) == found(quota.burn_rates(samples, ["window"]).collect())


def test_burn_rate_skips_resets_repeats_and_bad_readings(spark):
    samples = [("w", 0, 1, 10.0, "a", "1", "ok"), ("w", 10, 2, 30.0, "a", "2", "ok"), ("w", 15, 3, 90.0, "a", "2", "ok"), ("w", 20, 4, 50.0, "b", "3", "ok"), ("w", 25, 5, 99.0, "b", "4", "error"), ("w", 30, 6, None, "b", "5", "ok"), ("w", 30, 7, 71.0, "b", "6", "ok")]
    df = spark.createDataFrame(samples, "window string, at long, seq long, used double, resets_at string, updated_at string, status string")
    out = quota.burn_rates(df, ["window"]).first()
    assert (out["at"], out["used"], out["rate"]) == (30.0, 71.0, 2.1)  # 2.0, kept over the reset, then up at once


def test_days_and_periods_do_not_depend_on_the_session_zone(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        now, other = ts("2024-01-30 02:00:00Z"), ts("2024-01-29 23:00:00Z")
        none = F.lit(None).cast("timestamp")
        cases = [devices.is_open(now, none, other, "today"), devices.is_open(now, none, now, "today"), devices.is_open(now, none, none, "today"), devices.is_open(ts("2024-02-01 01:00:00Z"), none, ts("2024-01-31 23:00:00Z"), "month"), devices.is_plausible_day(F.lit("2024-01-29").cast("date"), now), devices.is_plausible_day(F.lit("2024-01-28").cast("date"), now)]
        assert list(spark.range(1).select(*cases).first()) == [False, True, True, False, True, False]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_identity_groups_of_a_long_chain(spark):
    df = spark.range(0, 150).selectExpr("id", "array(cast(id as string), cast(id + 1 as string)) as keys")
    assert {r["group"] for r in identity.grouped_by_identity(df, "id", "keys").collect()} == {0}


def test_prices_are_exact_or_unambiguous(spark):
    p = [("x/m1", 1.0), ("y/m1", 1.0), ("x/m2", 1.0), ("y/m2", 2.0), ("m3", 3.0)]
    prices = spark.createDataFrame([(k, r, r, r, r) for k, r in p], "model_key string, input_rate double, output_rate double, read_rate double, write_rate double")
    asked = spark.createDataFrame([(m,) for m in ("x/m2", "m1", "m2", "m3", "z/m1", "auto")], "model string")
    out = {r["model"]: r["rates"] and r["rates"]["input_rate"] for r in money.priced(asked, prices).collect()}
    assert out == {"x/m2": 1.0, "m1": 1.0, "m2": None, "m3": 3.0, "z/m1": None, "auto": None}


def test_a_used_component_without_a_rate_has_no_cost(spark):
    df = spark.createDataFrame([(10, 0, 2.0, None), (10, 1, 2.0, None), (10, 1, 2.0, 0.5)], "i long, o long, ir double, orr double")
    rates = F.struct(F.col("ir").alias("input_rate"), F.col("orr").alias("output_rate"))
    assert [r[0] for r in df.select(money.row_cost({"input_rate": F.col("i"), "output_rate": F.col("o")}, rates)).collect()] == [20.0, None, 20.5]


def test_subscriptions(spark):
    df = spark.createDataFrame([(D(2024, 1, 31), 1), (D(2024, 2, 29), 12), (D(2025, 1, 1), 1)], "start date, months int")
    today = F.lit(D(2024, 6, 30))
    out = df.select(money.next_renewal(F.col("start"), F.col("months"), today), money.elapsed_charges(F.col("start"), F.col("months"), today), money.elapsed_charges(F.col("start"), F.col("months"), today, F.lit(D(2024, 3, 1)))).collect()
    assert [tuple(r) for r in out] == [(D(2024, 6, 30), 6, 2), (D(2025, 2, 28), 1, 1), (D(2025, 1, 1), 0, 0)]


def test_identity_groups_are_transitive(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, ["c"]), (5, [])], "id long, keys array<string>")
    assert rows(identity.grouped_by_identity(df, "id", "keys")) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    prints = spark.createDataFrame([("l", "abcdefgh1"), ("l", "abcdefzh1"), ("m", "abcdefgh1")], "label string, print string")
    assert rows(identity.unique_prefix(prints, "label", "print")) == [("l", "abcdefgh1", "abcdefg"), ("l", "abcdefzh1", "abcdefz"), ("m", "abcdefgh1", "abcdef")]


def test_transcripts(spark):
    events = spark.createDataFrame([("s", 1, "turn", 5), ("s", 2, "prompt", 0), ("s", 3, "turn", 10), ("s", 4, "turn", 20), ("s", 5, "prompt", 0)], "session string, seq long, kind string, tokens long")
    assert rows(transcripts.exchanges(events)) == [("s", 0, 1, 5, 1), ("s", 1, 2, 30, 2), ("s", 2, 0, 0, 5)]
    log = [{"type": "user", "uuid": "u1", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "uuid": "u2", "message": {"id": "m1", "usage": {"input_tokens": 100, "output_tokens": 10}}}, {"type": "assistant", "uuid": "u2", "message": {"id": "m1", "usage": {"input_tokens": 100, "output_tokens": 10}}}, {"type": "assistant", "uuid": "u3", "message": {"id": "m1", "usage": {"input_tokens": 100, "output_tokens": 99}}}]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(log)] + [("f", 9, "{broken")], "file string, seq long, value string")
    assert [(r["kind"], r["tokens"]) for r in files.chat_events(df).orderBy("seq").collect()] == [("prompt", 0), ("turn", 110)]


def test_usage_rows_of_json(spark):
    docs = [
        {"client": "Claude Code", "sessionId": "s", "model": "M", "input": 10, "output_tokens": "5", "cacheRead": 3, "reasoning": 99, "cost": "$0.30"},
        {"source": "reasonix", "model": "deepseek/x", "input": 10, "output": 5, "reasoning": 7},
        {"client": "codex", "totalTokens": 50, "input": 1}, {"client": "codex"}, {"input": 5},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    out = [(r["client"], r["model"], r["total"], r["output"], r["cost"]) for r in files.usage_rows(df).collect()]
    assert sorted(out, key=repr) == [("claude", "m", 18, 5, 0.3), ("codex", None, 50, 0, 0.0), ("reasonix", "x", 22, 12, 0.0)]
    nested = spark.createDataFrame([(json.dumps({"a": [{"deep": docs[0]}, docs[1]], "b": {"client": "codex", "tokens": 7, "child": docs[0]}}),), ("{bad",), (None,)], "value string")
    assert sorted(r["total"] for r in files.nested_usage_rows(nested).collect()) == [7, 18, 22]


def test_graph_days_ignore_reported_totals(spark):
    day = {"date": "2026-01-02", "totals": {"tokens": 9999}, "clients": [{"client": "claude", "modelId": "m", "tokens": {"input": 10, "output": 20, "cacheRead": 5, "cacheWrite": 5, "reasoning": 50}, "cost": 1.5, "messages": 2}]}
    df = spark.createDataFrame([(json.dumps({"contributions": [day, {"date": "bad", "clients": day["clients"]}]}),)], "value string")
    assert rows(files.graph_days(df)) == [(D(2026, 1, 2), "claude", "m", 40, 1.5, 2)]


def test_sqlite_source(spark, tmp_path):
    paths = []
    for n in range(2):
        paths.append(str(tmp_path / f"{n}.db"))
        with sqlite3.connect(paths[-1]) as db:
            db.execute("create table t (id text, v integer)")
            db.executemany("insert into t values (?, ?)", [(f"r{n}", n), ("same", 10 + n)])
    out = files.sqlite_rows(spark, paths, "select id, v from t where v >= 1", "id string, v long")
    assert rows(out) == [("r1", 1), ("same", 10), ("same", 11)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"x', None), ("l\r\n", "plain", 3)], "a string, b string, c long")
    assert [r["line"] for r in export.csv_lines(df, ["a", "b", "c"]).collect()] == ['"a,b","q""x",', '"l\r\n",plain,3']
    export.write_csv(df.limit(1), f"file://{tmp_path}/csv")
    sized = spark.createDataFrame([(i, 10) for i in range(10)], "i long, n long")
    assert [r["i"] for r in export.budgeted(sized, [], [F.col("i").desc()], F.col("n"), 35).collect()] == [9, 8, 7]


QUOTAS = {
    "claude": ({"five_hour": {"utilization": 12.5, "resets_at": "2026-01-01T00:00:00Z"}, "seven_day": {"utilization": 40}, "spend": {"enabled": True, "used": {"amount_minor": 235, "exponent": 2}, "limit": {"amount_minor": 2000, "exponent": 2}}}, [("session", None, 12.5), ("weekly", None, 40.0), ("billing", "Usage credits", 11.75)]),
    "claude_text": ("Current session\n 80% left\nCurrent week (all models) 55% left", [("session", None, 20.0), ("weekly", None, 45.0)]),
    "codex": ({"primary": {"usedPercent": 5, "windowDurationMins": 300}, "secondary": {"used_percent": 7, "window_duration_mins": 10080}}, [("session", None, 5.0), ("weekly", None, 7.0)]),
    "cursor": ({"requests": {"used": 50, "limit": 500}, "plan": {"autoPercentUsed": 3}}, [("billing", "Total", 10.0), ("billing", "Auto", 3.0)]),
    "antigravity": ({"groups": [{"displayName": "Gemini", "buckets": [{"window": "5h", "remainingFraction": 0.25}, {"window": "weekly", "remainingFraction": 1.0}]}]}, [("session", "Gemini 5-hour", 75.0), ("weekly", "Gemini weekly", 0.0)]),
    "opencode": ({"web": {"rolling": {"usagePercent": 9}}, "go": {"rolling": {"usagePercent": 8}}, "zen": {"balance": 4}}, [("session", None, 8.0), ("billing", "Zen", None)]),
    "openrouter": ({"data": {"limit": 10, "usage": 4, "limit_reset": "weekly"}, "credits": {"total_credits": 20, "total_usage": 5}}, [("weekly", "Weekly limit", 40.0), ("billing", "Credits", 25.0)]),
    "deepseek": ({"balance_infos": [{"total_balance": "7.5"}], "month_spend": 2.5}, [("billing", "Balance", 25.0)]),
    "minimax": ({"current_interval_remaining_percent": "30", "current_interval_status": 1, "current_weekly_remaining_percent": "100", "current_weekly_status": 3}, [("session", "5h", 70.0)]),
    "mimo": ({"data": {"monthUsage": {"items": [{"name": "month_total_token", "used": 20, "limit": 80}]}}}, [("billing", "Token plan", 25.0)]),
    "grok": ({"config": {"creditUsagePercent": 33, "currentPeriod": {"start": "2026-01-01T00:00:00Z", "end": "2026-01-08T00:00:00Z"}}}, [("billing", "Weekly", 33.0)]),
    "copilot": ({"premium": {"percentRemaining": 60}, "chat": {"percentRemaining": 100}}, [("billing", "Premium", 40.0), ("billing", "Chat", 0.0)]),
    "kiro": ("Credits: 25 / 100\nBonus credits 10 of 40, expires in 5 days\nOverages: 3", [("billing", "Credits", 25.0), ("billing", "Bonus", 25.0), ("billing", "Overage", None)]),
    "zai": ({"data": {"limits": [{"type": "TOKENS_LIMIT", "unit": 6, "number": 1, "percentage": 20}, {"type": "TOKENS_LIMIT", "unit": 3, "number": 5, "percentage": 10}, {"type": "TIME_LIMIT", "unit": 5, "number": 1, "percentage": 30, "remaining": 70}]}}, [("session", "5-hour", 10.0), ("weekly", "Weekly", 20.0), ("billing", "MCP", 30.0)]),
    "volcengine": ({"Result": {"Quotas": [{"Level": "5h", "Percent": 1.5}, {"Level": "month", "Percent": 2.5}, {"Level": "other", "Percent": 3}]}}, [("session", "5-hour", 1.5), ("billing", "Monthly", 2.5)]),
    "commandcode": ({"credits": {"monthlyCredits": 5, "purchasedCredits": 0, "windowLimits": {"fiveHour": {"used": 2, "cap": 8}}}}, [("session", None, 25.0), ("billing", "Monthly", None)]),
    "qoder": ({"data": {"totalQuota": {"quotaSummary": {"usedValue": 10, "limitValue": 50}}, "sharedQuota": {"quotaSummary": {"usedValue": 10, "limitValue": 50}}}}, [("billing", "Credits", 20.0)]),
    "ollama": ("<b>Session usage</b> 12.5% used <b>Weekly usage</b> 3% used", [("session", None, 12.5), ("weekly", None, 3.0)]),
    "kimi": ({"rateLimit5h": {"ratio": 0.25}, "weekly": {"usedRatio": 0.5}}, [("session", "5-hour", 25.0), ("weekly", "Weekly", 50.0)]),
    "thirdparty": ({"label": "Key", "remaining": 30, "used": 10}, [("billing", "Key", 25.0)]),
}


@pytest.mark.parametrize("provider", sorted(QUOTAS))
def test_quota_adapters(spark, provider):
    body, want = QUOTAS[provider]
    text = body if isinstance(body, str) else json.dumps(body)
    df = spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "id long, body string")
    out = quota_adapters.quota_windows(df, provider).orderBy("id").collect()
    assert [(r["kind"], r["label"], r["used_percent"]) for r in out if r["id"] == 1] == want and all(r["id"] == 1 for r in out)


def test_window_numbers(spark):
    df = spark.createDataFrame([("5", "20", None, None), ("30", "20", None, None), (None, None, "3", None), (None, None, None, "45%")], "u string, m string, r string, p string")
    n = quota.window_numbers(*[F.col(c) for c in "umrp"])
    assert [tuple(r) for r in df.select(n["used_percent"], n["remaining"], n["remaining_percent"]).collect()] == [(25.0, None, 75.0), (100.0, None, 0.0), (None, 3.0, None), (45.0, None, 55.0)]


def test_event_logs_replay_until_damage(spark):
    events = [("a", 1, "replace", None, ["x", "y"]), ("a", 2, "append", 2, ["z"]), ("a", 3, "replace", None, ["n"]), ("a", 4, "append", 1, ["m"]), ("b", 1, "append", 0, ["p"]), ("b", 2, "append", 5, ["q"]), ("b", 3, "replace", None, ["r"]), ("c", 1, "odd", None, None)]
    df = spark.createDataFrame(events, "file string, seq long, type string, at_index int, messages array<string>")
    assert rows(transcripts.replayed(df)) == [("a", ["n", "m"], False), ("b", ["p"], True), ("c", [], True)]


def test_previews_keep_fields_until_complete(spark):
    df = spark.createDataFrame([("d", 1, 5, 50, False), ("d", 2, 6, None, True), ("d", 3, 7, None, False)], "device string, at long, today long, month long, partial boolean")
    assert [r["month"] for r in devices.carried(df, ["device"], ["at"], ["month"], F.col("partial")).orderBy("at").collect()] == [50, 50, None]


def test_prefixes_of_all_customers(spark, sf_dir):
    from meterline.plans import catalog

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_custkey").collect()
    prints = [(label, hashlib.md5(str(key).encode()).hexdigest()) for label, key in customers]
    least = lambda label, x: next(x[:n] for n in range(2, 33) if sum(m == label and y[:n] == x[:n] for m, y in prints) == 1)
    assert len(prints) > 59 and rows(catalog.QUERIES["shortest_unique_prefix"](spark, sf_dir)) == sorted((m, x, least(m, x)) for m, x in prints)


def test_records_that_are_no_objects_give_no_rows(spark):
    df = spark.createDataFrame([(1, "f", None), (2, "f", ""), (3, "f", "[1]"), (4, "f", "{"), (5, None, '{"client":"codex"}'), (6, "f", '{"client":" ","tool":"Codex","models":{"A":2,"a":"x"," ":3},"tokens":null,"input":"1,0"}')], "id long, fallback string, value string")
    assert rows(records.normalized_sessions(df).select("id", "client", "session", "total", "models")) == [(6, "codex", "f", 10, {"a": 2})]
    assert rows(records.normalized_readings(df).select("id")) == []
    empty = df.limit(0)
    assert all(rows(f(empty)) == [] for f in (records.normalized_sessions, records.normalized_readings, lambda x: records.normalized_health(x, [])))
    whole = spark.createDataFrame([(1, "{}"), (2, None), (3, '{"source":{"checkedCount":"NaN"},"collection":7}')], "id long, value string")
    assert rows(records.normalized_health(whole, []).select("id", "source", "overall")) == [(1, "unknown", "unknown"), (3, "unknown", "unknown")]
    assert rows(records.normalized_devices(whole, F.lit("2024-01-30").cast("timestamp")).select("id", "device", "history", "upload_ms")) == [(1, "unknown", None, None), (3, "unknown", None, None)]


def test_session_files(spark, tmp_path):
    for name in (".claude/projects/p/a.jsonl", ".claude/transcripts/a.jsonl", ".claude/transcripts/b.jsonl", ".codex/sessions/2026/01/02/rollout-2026-01-02T1-x.jsonl", ".codex/sessions/2025/01/02/rollout-2026-01-02T1-x.jsonl", ".codex/sessions/z/c.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    wanted = spark.createDataFrame([("claude", "a"), ("claude", "b"), ("codex", "rollout-2026-01-02T1-x"), ("codex", "c"), ("codex", "a"), (None, None)], "client string, session string")
    got = {(r["client"], r["session"]): r["path"] and r["path"].split(str(tmp_path) + "/")[1] for r in files.session_files(spark, f"file://{tmp_path}", wanted).collect()}
    assert got == {("claude", "a"): ".claude/projects/p/a.jsonl", ("claude", "b"): ".claude/transcripts/b.jsonl", ("codex", "rollout-2026-01-02T1-x"): ".codex/sessions/2026/01/02/rollout-2026-01-02T1-x.jsonl", ("codex", "c"): ".codex/sessions/z/c.jsonl", ("codex", "a"): None, (None, None): None}
    assert [r["path"] for r in files.session_files(spark, f"file://{tmp_path}/none", wanted).collect()] == [None] * 6


def test_native_sessions_from_sidecars(spark, tmp_path):
    metas = {"a": {"id": "A", "scope": "project", "workspace_root": "/w/App/", "created_at": "2026-01-01T00:00:00Z", "schema_version": 1, "turns": 3}, "b": {"branch": {"ID": "B"}, "turns": 3}, "c": {"id": "C"}, "d": {"id": "D"}, "e": {"name": "no id"}, "f": {"id": "F"}}
    for stem, meta in metas.items():
        (tmp_path / f"{stem}{files.META}").write_text(json.dumps(meta))
    for stem, usage in {"a": {"totalTokens": 10.4, "prompt_tokens": 7}, "b": {"promptTokens": 1}, "d": {"total_tokens": 5}, "e": {"totalTokens": 1}}.items():
        (tmp_path / f"{stem}{files.TELEMETRY}").write_text(json.dumps(usage))
    (tmp_path / f"b{files.EVENTS}").write_text("{}")
    found = files.sidecars(spark, str(tmp_path))
    folder = found[files.EVENTS].first()["folder"]
    logs = spark.createDataFrame([(folder, "b", 2, None), (folder, "d", None, None)], "folder string, stem string, messages long, last_message_at timestamp")
    out = files.native_sessions(found[files.META], found[files.TELEMETRY], logs).select("session", "scope", "project_label", "total", "prompt", "turns", "messages")
    assert rows(out) == [("reasonix:A", "project", "App", 10, 7, 3, None), ("reasonix:B", "global", None, None, None, None, 2)]


def test_scan_plan_of_many_ticks_takes_linear_time(spark):
    import time

    ticks = spark.range(80_000).select(F.when(F.col("id") % 2 == 0, "d").alias("device"), (F.col("id") * 7919 % 80_000).alias("at"), (F.col("id") % 3 == 0).alias("changed"))
    began = time.perf_counter()
    got = sorted(((r["device"] or "", r["at"], r["scan"]) for r in devices.scan_plan(ticks, ["device"]).collect()))
    assert time.perf_counter() - began < 30
    want, full_at = [], {}
    for device, at, changed in sorted((r["device"] or "", r["at"], r["changed"]) for r in ticks.collect()):
        full = device not in full_at or at - full_at[device] >= devices.FULL_SCAN_S
        full_at |= {device: at} if full else {}
        want.append((device, at, "full" if full else "anchored" if changed else "skip"))
    assert got == want


def test_scan_plan_with_ticks_at_one_time_and_without_time(spark):
    ticks = spark.createDataFrame([("a", 10, True), ("a", 10, False), ("a", 10, None), ("a", 3610, True), ("a", 3620, None), ("b", None, True), ("b", 5, True), ("b", 5, True)], "device string, at long, changed boolean")
    got = sorted((r["device"], r["at"] or 0, r["scan"]) for r in devices.scan_plan(ticks, ["device"]).collect())
    assert got == [("a", 10, "anchored"), ("a", 10, "full"), ("a", 10, "skip"), ("a", 3610, "full"), ("a", 3620, "skip"), ("b", 0, "full"), ("b", 5, "anchored"), ("b", 5, "full")]
