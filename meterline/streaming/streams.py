"""Structured Streaming over usage events: calendar days, session windows, deduplication, burn-rate state, keyed upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quota import RELEASE, measured

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = 100) -> DataFrame:
    """Events as a file stream, their times with a zone (watermarks need one) (K1). Without max_files a batch takes all files that there are."""
    reader = spark.readStream.schema(EVENTS)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days with a watermark (K5). In UTC only; days of other zones are keys, not windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("tokens")).select(F.to_date("w.start").alias("day"), "event_type", "events", "tokens")


def session_windows(events: DataFrame, gap: str = "5 hours", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap (K6)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def scans(changes: DataFrame, keys: list[str], quiet: str = "1500 milliseconds", late: str = "1 hour") -> DataFrame:
    """One scan a key after each quiet time (K2), of all tools that changed before it, or of everything where a change names no tool (K3). Changes: the keys, ts and client."""
    found = changes.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), *keys).agg(F.array_sort(F.collect_set("client")).alias("clients"), F.bool_or(F.col("client").isNull()).alias("everything"), F.count(F.lit(1)).alias("changes"))
    return found.select(*keys, F.col("w.end").alias("due"), F.when(~F.col("everything"), F.col("clients")).alias("scope"), "changes")


def without_repeats(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


BURN_STATE = "at double, used double, rate double, resets_at string, updated_at string"


def burn_rates(samples: DataFrame) -> DataFrame:
    """The burn rate of each window as keyed state: the streaming twin of quota.burn_rates (K13). Samples: window and what quota.measured takes.

    A batch's samples of a window are folded in order of (at, seq), also when they come in several frames; samples older than the state are void.
    What a task holds at once is one window's samples of a batch.
    """
    columns = ["at", "seq", "used", "resets_at", "updated_at"]

    def fold(key, frames: Iterator, state):
        import pandas as pd

        at, used, rate, resets_at, updated_at = state.get if state.exists else (None, None, 0.0, None, None)
        parts = [frame[columns] for frame in frames]  # a window has several where Arrow's batches end
        samples = parts[0] if len(parts) == 1 else pd.concat(parts)
        for row in samples.sort_values(["at", "seq"]).itertuples():
            if at is not None:
                if row.at < at or row.updated_at is not None and row.updated_at == updated_at:
                    continue
                elapsed = row.at - at
                if row.used >= used and row.resets_at == resets_at and elapsed > 0:
                    now = (row.used - used) / elapsed
                    rate = now if now >= rate else RELEASE * now + (1 - RELEASE) * rate
            at, used, resets_at, updated_at = float(row.at), float(row.used), row.resets_at, row.updated_at
        state.update((at, used, rate, resets_at, updated_at))
        yield pd.DataFrame({"window": [key[0]], "at": [at], "used": [used], "rate": [rate]})

    return measured(samples).select("window", *columns).groupBy("window").applyInPandasWithState(fold, "window string, at double, used double, rate double", BURN_STATE, "update", "NoTimeout")


def keep_latest(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into a Parquet table by key. The table is written as versions named by batch, so a repeated batch writes the same version again."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id:
            rows = spark.read.parquet(f"{path}/v{batch_id - 1}").unionByName(batch)
        rest = [c for c in batch.columns if c not in keys]
        rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return merge


def run_to_end(stream: DataFrame, mode: str, shared: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that there is; the rows that it wrote, as Parquet beside its checkpoint in the folder of spark.checkpoint.dir.

    Each batch is written under its number, so that a repeated batch replaces itself. In complete mode the last batch is the result; in update
    mode, the last row of each of `keys`; in append mode, all rows.
    """
    import tempfile

    spark = stream.sparkSession
    shared = shared or spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="meterline-")  # unset in tests only
    home = f"{shared.rstrip('/')}/meterline/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={batch_id}")
        done.append(batch_id)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{home}/rows/batch={max(done)}")
    rows = spark.read.option("basePath", f"{home}/rows").parquet(f"{home}/rows")
    if mode == "update" and keys:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return rows.drop("batch")
