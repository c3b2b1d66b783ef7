"""Prices, currencies, balances, subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATES = ("input_rate", "output_rate", "read_rate", "write_rate")


def catalog(sources: DataFrame, now: Column) -> DataFrame:
    """Of each model key its rates from the first source; entries dated in the future wait."""
    rest = [c for c in sources.columns if c != "model_key"]
    return sources.filter(F.col("dated") <= now).groupBy("model_key").agg(F.min_by(F.struct(*rest), "priority").alias("p")).select("model_key", "p.*")


def terminal(key: Column) -> Column:
    """The last segment of a model key."""
    return F.element_at(F.split(key, "/"), -1)


def priced(rows: DataFrame, prices: DataFrame, blocked: tuple[str, ...] = ("auto",)) -> DataFrame:
    """Rows with rates: by exact key, else by last segment if the key has no / and is not blocked and all candidates have the same rates."""
    exact = prices.select(F.col("model_key").alias("model"), F.struct(*RATES).alias("exact"))
    alike = prices.groupBy(terminal(F.col("model_key")).alias("model")).agg(F.count_distinct(F.struct(*RATES)).alias("n"), F.first(F.struct(*RATES)).alias("similar")).filter("n = 1").drop("n")
    open_key = ~F.col("model").contains("/") & ~F.col("model").isin(*blocked)
    return rows.join(exact, "model", "left").join(alike, "model", "left").withColumn("rates", F.coalesce("exact", F.when(open_key, F.col("similar")))).drop("exact", "similar")


def row_cost(tokens: dict[str, Column], rates: Column) -> Column:
    """The cost of a row; null if a component that is used lacks a rate that is a number >= 0."""
    total, known = F.lit(0.0), F.lit(True)
    for name, count in tokens.items():
        rate = rates[name]
        fine = F.coalesce((rate >= 0) & (rate < float("inf")), F.lit(False))
        known = known & ((count <= 0) | fine)
        total = total + F.when(count > 0, count * rate).otherwise(0.0)
    return F.when(known & rates.isNotNull(), total)


def spending(balances: DataFrame, account: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Drops between consecutive balances; rises are top-ups and count nothing."""
    over = Window.partitionBy(account).orderBy(*order)
    return balances.withColumn("spent", F.greatest(F.lit(0), F.coalesce(F.lag(value).over(over) - F.col(value), F.lit(0))))


def next_renewal(start: Column, months: Column, today: Column) -> Column:
    """The first anchor + k * months that is not before today, from the anchor's own day (M6)."""
    k = F.greatest(F.lit(0), F.floor(F.months_between(today, start) / months).cast("int"))
    step = lambda i: F.add_months(start, (k + i) * months)
    return F.when(step(0) >= today, step(0)).when(step(1) >= today, step(1)).otherwise(step(2))


def elapsed_charges(start: Column, months: Column, today: Column, stop: Column | None = None) -> Column:
    """How many charges fell due up to today and before the stop, the first included (M8)."""
    last = F.greatest(F.lit(0), F.ceil(F.months_between(today, start) / months).cast("int") + 1)
    due = F.transform(F.sequence(F.lit(0), last), lambda k: F.add_months(start, k * months))
    return F.when(start <= today, F.size(F.filter(due, lambda d: (d <= today) & (F.lit(True) if stop is None else F.coalesce(d < stop, F.lit(True)))))).otherwise(0)


def coverage_stop(end: Column, renews: Column, start: Column, months: Column) -> Column:
    """Where coverage stops: the end, else one period after the start if it does not renew, else never (M7)."""
    return F.when(end.isNotNull(), end).when(~renews, F.add_months(start, months))


def is_active(stop: Column, today: Column) -> Column:
    return stop.isNull() | (stop > today)


def monthly_minor(amount: Column, months: Column) -> Column:
    """A plan's price a month in minor units."""
    return F.floor(amount / months + 0.5).cast("long")


def exhaustion(poured: Column, left: Column, first: Column, today: Column) -> Column:
    """The day on which a topped-up balance ends at its mean burn, or null."""
    days = F.greatest(F.lit(1), F.datediff(today, first))
    burn = (poured - left) / days
    return F.when(burn > 0, F.date_add(today, F.floor(left / burn).cast("int")))


def match_accounts(subscriptions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each subscription's account: by key, else e-mail, else a profile name that one account has, else the only account of the provider.

    One join a rung, each with at most one account a key, so no provider's subscriptions meet all its accounts.
    """

    def rung(key: str | None, alone: bool, name: str, asked: str | None) -> tuple[DataFrame, list[Column]]:
        keys = ["provider", *([key] if key else [])]
        one = accounts.groupBy(*keys).agg(F.min("account_key").alias(name), F.count(F.lit(1)).alias("n"))
        one = one.filter("n = 1") if alone else one
        one = one.select(F.col("provider").alias(f"{name}_provider"), *([F.col(key).alias(f"{name}_key")] if key else []), name)
        return one, [F.col("provider") == F.col(f"{name}_provider"), *([F.col(asked) == F.col(f"{name}_key")] if asked else [])]

    rungs = [("account_key", False, "r1", "bound_key"), ("email", False, "r2", "email"), ("profile", True, "r3", "profile"), (None, True, "r4", None)]
    met = subscriptions.select("id", "provider", "bound_key", "email", "profile")
    for one, on in (rung(*r) for r in rungs):
        met = met.join(one, on, "left")
    first = F.coalesce(*[F.when(F.col(f"r{i}").isNotNull(), F.struct(F.lit(i).alias("rank"), F.col(f"r{i}").alias("account_key"))) for i in range(1, 5)])
    best = met.groupBy("id").agg(F.min(first).alias("best"))
    return best.select("id", "best.account_key", "best.rank")

