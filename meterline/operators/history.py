"""Daily and monthly history: rollups, streaks, intensities, favourites, windows, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import intensity

WINDOW_DAYS = 370


def daily(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums by day and keys."""
    return rows.groupBy("day", *keys).agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("cost_nano").cast("long").alias("cost_nano"), F.count(F.lit(1)).alias("messages"))


def monthly(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of days by month."""
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month"), *keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("tokens", "cost_nano", "messages")])


def rolling(days: DataFrame, today: str, size: int = WINDOW_DAYS) -> DataFrame:
    """The days of the window that ends today, both ends counted; later days are out."""
    end = F.lit(today).cast("date")
    return days.filter(F.col("day").between(F.date_sub(end, size - 1), end))


def streak_runs(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive active days: keys, start, end, length (G1). One small row a day and key meets in a window of its key."""
    active = days.filter("tokens > 0").select(*keys, "day").distinct()
    over = Window.partitionBy(*keys).orderBy("day") if keys else Window.partitionBy(F.lit(0)).orderBy("day")  # days, not rows: a calendar's length
    return active.withColumn("island", F.date_sub("day", F.row_number().over(over))).groupBy(*keys, "island").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("length")).drop("island")


def streaks(days: DataFrame, today: str, keys: Sequence[str] = ()) -> DataFrame:
    """The run that ends today (0 if none) and the longest run."""
    ends = F.when(F.col("end") == F.lit(today).cast("date"), F.col("length")).otherwise(0)
    return streak_runs(days, keys).groupBy(*keys).agg(F.max(ends).alias("current_streak"), F.max("length").alias("longest_streak"))


def trailing_streak(days: DataFrame, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Active days counted back from the end of a zero-filled range."""
    last = F.lit(end).cast("date")
    idle = F.max(F.when(F.col("tokens") <= 0, F.col("day")))
    return days.filter(F.col("day") <= last).groupBy(*keys).agg(F.datediff(last, F.coalesce(idle, F.date_sub(F.min("day"), 1))).alias("trailing_streak"))


def with_intensity(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Token and cost intensities, each by the largest day."""
    largest = days.groupBy(*keys).agg(F.max("tokens").alias("most_tokens"), F.max("cost_nano").alias("most_cost"))
    joined = days.join(largest, list(keys)) if keys else days.crossJoin(largest)  # one row
    return joined.withColumns({"token_intensity": intensity(F.col("tokens"), F.col("most_tokens")), "cost_intensity": intensity(F.col("cost_nano"), F.col("most_cost"))}).drop("most_tokens", "most_cost")


def favourite(rows: DataFrame, name: str = "model", keys: Sequence[str] = ()) -> DataFrame:
    """The name with most tokens; of equal ones that with the earliest day, then row."""
    totals = rows.groupBy(*keys, name).agg(F.sum("tokens").cast("long").alias("tokens"), F.min(F.struct("day", "row_id")).alias("first"))
    rank = F.struct(-F.col("tokens"), F.col("first"))
    return totals.groupBy(*keys).agg(F.min_by(name, rank).alias("favourite"), F.max("tokens").alias("tokens"))


def summary(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total, cost, active days, peak and its day, messages."""
    peak = F.max_by("day", F.struct("tokens", F.datediff(F.lit("9999-12-31").cast("date"), "day")))
    return days.groupBy(*keys).agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("cost_nano").cast("long").alias("cost_nano"), F.count_if(F.col("tokens") > 0).alias("active_days"), F.max("tokens").alias("peak_tokens"), peak.alias("peak_day"), F.sum("messages").cast("long").alias("messages"))


def merged_summary(days: DataFrame, months: DataFrame, today: str) -> DataFrame:
    """Of several devices: totals from the months, activity from the window of days."""
    lifetime = months.agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("messages").cast("long").alias("messages"))
    recent = rolling(days, today).groupBy("day").agg(F.sum("tokens").cast("long").alias("tokens"))
    window = recent.agg(F.count_if(F.col("tokens") > 0).alias("active_days"), F.max("tokens").alias("peak_tokens"))
    return lifetime.crossJoin(window)  # one row by one row


def last_active(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last day with tokens (F32)."""
    return days.filter("tokens > 0").groupBy(*keys).agg(F.max("day").alias("last_day"))


def last_rows(days: DataFrame, n: int, order: str = "day") -> DataFrame:
    """The last n rows that there are, not calendar days (C20, H9, M5)."""
    return days.orderBy(F.col(order).desc()).limit(n)


def filled(days: DataFrame, start: str, end: str, columns: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """Every day of a range, missing ones as zeros, for each row of `keys` (I4)."""
    spark = days.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    names = list(keys.columns) if keys is not None else []
    grid = calendar if keys is None else keys.crossJoin(F.broadcast(calendar))  # a calendar has as many rows as its range has days
    return grid.join(days, ["day", *names], "left").fillna(0, subset=list(columns))


def candles(days: DataFrame, n: int, value: str = "tokens") -> DataFrame:
    """Buckets of n calendar days counted back from the last: open and close by day, high and low by value."""
    last = days.agg(F.max("day").alias("last"))
    age = F.floor(F.datediff("last", "day") / n).cast("int")
    return days.crossJoin(last).groupBy(age.alias("age")).agg(F.min("day").alias("start"), F.max("day").alias("end"), F.min_by(value, "day").alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, "day").alias("close"))  # one row


def heatmap(days: DataFrame) -> DataFrame:
    """Calendar cells: columns of weeks that begin on Sunday, rows of weekdays."""
    first = days.agg(F.min("day").alias("first"))
    origin = F.date_sub("first", F.dayofweek("first") - 1)
    return days.crossJoin(first).withColumns({"col": F.floor(F.datediff("day", origin) / 7).cast("int"), "row": F.dayofweek("day") - 1}).drop("first")  # one row


def week_of(today: Column, first_weekday: int = 0) -> tuple[Column, Column]:
    """The bounds of the week that today is in."""
    start = F.date_sub(today, F.pmod(F.weekday(today) - first_weekday, F.lit(7)))
    return start, F.date_add(start, 6)


def with_live_today(days: DataFrame, live: DataFrame, today: str, rule: str = "at_least") -> DataFrame:
    """History with a live row of today: it replaces the stored one if as large ("at_least"), always ("always"), or the larger value is kept ("larger")."""
    stored = days.select("day", F.col("tokens").alias("stored"))
    now = live.select(F.lit(today).cast("date").alias("day"), F.col("tokens").alias("live"))
    both = stored.join(now, "day", "full_outer")
    value = {"at_least": F.when(F.col("live") >= F.coalesce("stored", F.lit(0)), F.col("live")), "always": F.col("live"), "larger": F.greatest("live", "stored")}[rule]
    return both.select("day", F.coalesce(value, "stored", "live").alias("tokens"))
