"""Transcripts: events, exchanges, turns, chunk dedup and cost allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_exchange(events: DataFrame, session: str = "session", seq: str = "seq", is_prompt: Column | None = None) -> DataFrame:
    """Each event with its exchange: the number of prompts so far; turns before the first prompt are exchange 0."""
    prompt = is_prompt if is_prompt is not None else F.col("kind") == "prompt"
    over = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("exchange", F.sum(F.when(prompt, 1).otherwise(0)).over(over))


def exchanges(events: DataFrame, session: str = "session") -> DataFrame:
    """Turns and tokens of each exchange."""
    turn = F.col("kind") == "turn"
    return with_exchange(events, session).groupBy(session, "exchange").agg(F.count_if(turn).alias("turns"), F.coalesce(F.sum(F.when(turn, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"), F.min("seq").alias("first_seq"))


def allocate(rows: DataFrame, cost: str, weight: str, session: str = "session") -> DataFrame:
    """A session's cost over its rows by weight; nothing where the session has none."""
    whole = F.sum(weight).over(Window.partitionBy(session))
    return rows.withColumn("allocated", F.when(whole > 0, F.col(cost) * F.col(weight) / whole).otherwise(0.0))


def best_chunk(chunks: DataFrame, keys: Sequence[str], total: str, at: str) -> DataFrame:
    """Of the chunks of a message that with most tokens, and the latest time of all."""
    rest = [c for c in chunks.columns if c not in keys and c != at]
    return chunks.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(total, at, "chunk_id")).alias("c"), F.max(at).alias(at)).select(*keys, "c.*", at)


def first_by_message(lines: DataFrame, uuid: str = "uuid", message: str = "message_id", seq: str = "seq") -> DataFrame:
    """Lines without repeated uuids, then of each message its first line with the tools of all."""
    once = lines.withColumn("_n", F.row_number().over(Window.partitionBy("file", F.coalesce(uuid, F.concat(F.lit("line "), F.col(seq).cast("string")))).orderBy(seq))).filter("_n = 1").drop("_n")
    key = F.coalesce(message, F.concat(F.lit("line "), F.col(seq).cast("string")))
    rest = [c for c in lines.columns if c not in ("file", "tools")]
    return once.groupBy("file", key.alias("_key")).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("tools")).select("file", "l.*", "tools")


def buffered_tools(events: DataFrame, session: str = "session") -> DataFrame:
    """Tool events belong to the next turn: turns with the tools since the turn before."""
    turn = F.col("kind") == "turn"
    after = Window.partitionBy(session).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    grouped = events.withColumn("turn_id", F.sum(F.when(turn, 1).otherwise(0)).over(after))
    fresh = F.greatest(F.lit(0), F.max(F.when(turn, F.col("input"))) - F.coalesce(F.max(F.when(turn, F.col("cached"))), F.lit(0)))
    return grouped.filter("turn_id > 0").groupBy(session, "turn_id").agg(F.max(F.when(turn, F.col("seq"))).alias("seq"), fresh.alias("fresh_input"), F.array_sort(F.collect_set(F.when(F.col("kind") == "tool", F.col("name")))).alias("tools"))


def session_order(rows: DataFrame, n: int) -> DataFrame:
    """The n sessions by recency, tokens, cost, then name (H1)."""
    return rows.orderBy(F.col("last_used_at").desc(), F.col("total").desc(), F.col("cost_nano").desc(), "client", "session").limit(n)


def replayed(events: DataFrame, most_messages: int = 10_000) -> DataFrame:
    """The messages of event logs (file, seq, type, at_index, messages): replace sets them, append adds at the end.

    An append at another place, an unknown type or too many messages stops a log: later events don't count, and it is marked.
    """
    event = F.struct("seq", "type", "at_index", F.coalesce("messages", F.array().cast("array<string>")).alias("messages"))
    logs = events.groupBy("file").agg(F.array_sort(F.collect_list(event)).alias("log"))
    start = F.struct(F.array().cast("array<string>").alias("messages"), F.lit(False).alias("stopped"))

    def step(s: Column, e: Column) -> Column:
        grown = F.concat(s["messages"], e["messages"])
        fine = ((e["type"] == "replace") & (F.size(e["messages"]) <= most_messages)) | ((e["type"] == "append") & (e["at_index"] == F.size(s["messages"])) & (F.size(grown) <= most_messages))
        fine = F.coalesce(fine, F.lit(False)) & ~s["stopped"]
        messages = F.when(fine & (e["type"] == "replace"), e["messages"]).when(fine, grown).otherwise(s["messages"])
        return F.struct(messages.alias("messages"), (~fine).alias("stopped"))

    return logs.select("file", F.aggregate("log", start, step).alias("s")).select("file", "s.messages", F.col("s.stopped").alias("damaged"))
