"""Scalar functions on the values that define them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterline.functions import scalars as S


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def test_numbers(spark):
    assert column(spark, ["$1,234.50", " 12 ", "", "abc", "1e3", "-7", None, "NaN", "12%"], S.lenient_number) == [1234.5, 12.0, 0.0, 0.0, 1000.0, -7.0, 0.0, 0.0, 0.0]
    assert column(spark, ["12%", "x", None], S.quota_number) == [12.0, None, None]
    assert column(spark, ["0", "5"], lambda x: S.first_number(x, F.lit("7"))) == [7.0, 5.0]


def test_clients_and_models(spark):
    raw = ["Claude Code", "my codex", "api pi x", "pipeline", "Command_Code", "qoder-cn", "Qoder CN", "moldbot", "Some New!! Tool ", "", None, "gemini claude"]
    assert column(spark, raw, S.client_id) == ["claude", "codex", "pi", "pipeline", "commandcode", "qodercn", "qodercn", "openclaw", "some-new-tool", None, None, "claude"]
    assert column(spark, ["DeepSeek/V3", " GPT-5 ", "auto", ""], lambda x: S.model_id(x, F.lit("reasonix"))) == ["v3", "gpt-5", "auto", None]
    assert column(spark, ["auto"], lambda x: S.model_id(x, F.lit("cursor"))) == ["cursor-auto"]
    models = ["claude-opus-4", "o3-mini", "gemma-2", "qwq", "glm-4.6", "command-r", "abab6", "seed-1", "big-pickle", "nothing", None, "cursor-auto"]
    assert column(spark, models, S.model_vendor) == ["claude", "codex", "gemini", "qwen", "zai", "cohere", "minimax", "doubao", "opencode", None, None, "cursor"]


def test_keys_need_nfc_only_beyond_ascii(spark):
    assert column(spark, [" My App ", "Cafe\u0301", "CAFÉ", "", None], S.nfc_key) == ["my app", "café", "café", None, None]
    labels = ["a@b.co", "a＠b", "see HTTPS://x", "Team ＡＢ!", "Cafe\u0301 +1", None, "x" * 32, "x" * 33]
    assert column(spark, labels, S.account_label) == ["", "", "", "Team ＡＢ", "Café +1", "", "x" * 32, ""]
    assert column(spark, ["Ann +1", "x" * 64, "x" * 65], S.account_name) == ["Ann 1", "x" * 64, ""]
    assert column(spark, [" A@B.co", "a@b", "a b@c.de", None], S.account_email) == ["a@b.co", "", "", ""]


def _signed(text):
    h = 0
    for c in text:
        unit = int.from_bytes(c.encode("utf-16-be")[:2], "big")
        h = (h * 31 + unit + 2**31) % 2**32 - 2**31
    return h


def test_text(spark):
    assert column(spark, ["full@x.org", "a@b", "no-mail", "@x"], S.masked_email) == ["f***l@x.org", "a***@b", "no-mail", "@x"]
    assert column(spark, ["rollout-2024-01-02T03-04-05-abc", "rollout-2024-01-02T03-04-05", "plain"], S.session_label) == ["abc", "", "plain"]
    assert column(spark, ["x-2024-01-02T03-04-05-abc", "none"], S.session_time) == [dt.datetime(2024, 1, 2, 3, 4, 5), None]
    assert column(spark, ["C:\\Users\\me\\app\\", "/a//b/", "/"], S.project_path) == ["c:/Users/me/app", "/a/b", "/"]
    assert column(spark, ["a [Image #1]  b\n c"], S.prompt_text) == ["a b c"]
    assert column(spark, ["connect ETIMEDOUT", "HTTP 429", "open: EACCES", "rpc error", None], S.error_code) == ["network-timeout", None, "permission-denied", None, None]
    assert column(spark, ["", "a", "zzzzzzz", "\U0001f600"], S.stable_colour) == [abs(_signed(x)) % 12 for x in ("", "a", "zzzzzzz", "\U0001f600")]


@pytest.mark.parametrize("units,values,want", [
    ("western", [0, 999, 1000, 1500, 999_949, 999_950, 12_345_678, 2_000_000_000], ["0", "999", "1K", "1.5K", "999.9K", "1M", "12.3M", "2B"]),
    ("ja", [9999, 12_345, 123_456, 99_999_999, 250_000_000], ["9999", "1.23万", "12.3万", "1億", "2.5億"]),
])
def test_compact_numbers(spark, units, values, want):
    assert column(spark, values, lambda x: S.compact(x, units), "long") == want


def test_dates(spark):
    assert column(spark, ["2024-02-29", "2023-02-29", "24-1-1", None], S.strict_day) == [dt.date(2024, 2, 29), None, None, None]
    assert column(spark, [dt.datetime(2024, 3, 10, 4, 30)], lambda x: S.local_day(x, "America/New_York"), "timestamp") == [dt.date(2024, 3, 9)]
    assert column(spark, [dt.date(2024, 3, 10)], lambda x: S.day_end(x, "America/New_York"), "date") == [dt.datetime(2024, 3, 11, 4)]  # the day the clocks go on
    assert column(spark, [dt.date(2024, 1, 31)], lambda x: S.anchored_month(x, F.lit(1)), "date") == [dt.date(2024, 2, 29)]
    assert column(spark, [dt.date(2024, 1, 31)], lambda x: S.week_start(x, 6), "date") == [dt.date(2024, 1, 28)]
    assert column(spark, [1_700_000_000, 1_700_000_000_000], S.instant, "long") == [dt.datetime(2023, 11, 14, 22, 13, 20)] * 2
    assert column(spark, [0, 61_000, 3_600_000, None], S.duration, "long") == ["0m", "1m", "1h 0m", "0m"]


def test_levels(spark):
    most = F.lit(100.0)
    assert column(spark, [0.0, 1.0, 25.0, 50.0, 75.0, 100.0], lambda x: S.intensity(x, most), "double") == [0, 1, 2, 3, 4, 4]
    assert column(spark, [0.0, 1.0, 26.0, 100.0], lambda x: S.widget_intensity(x, most), "double") == [0, 1, 2, 4]
    assert column(spark, ["120", "x", "Wed, 21 Oct 2015 07:28:00 GMT"], lambda x: S.retry_delay(x, F.lit("2015-10-21 07:27:00").cast("timestamp"))) == [120_000, None, 60_000]
    assert column(spark, ["999999"], lambda x: S.retry_delay(x, F.lit("2015-10-21 07:27:00").cast("timestamp"))) == [3_600_000]
    assert column(spark, [0, 1, 2, 3, 9, 99], lambda x: S.backoff(x, F.lit(0.5)), "long") == [3750, 3750, 7500, 15_000, 225_000, 225_000]
