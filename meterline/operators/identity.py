"""Transitive grouping of records that share any identity key (E15), labels and suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_by_identity(records: DataFrame, record: str, keys: str) -> DataFrame:
    """Each record with the smallest record that shared keys reach.

    In a round a record takes the least label of the records that share a key with it, and then that label's own label, so labels
    travel twice as far each round. Rounds end when no label changes; each is checkpointed.
    """
    spark = records.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="meterline-"))
    held = records.select(F.col(record).alias("r"), F.explode(F.array_distinct(keys)).alias("k")).filter("k is not null")
    labels = records.select(F.col(record).alias("r"), F.col(record).alias("g")).distinct().checkpoint()
    while True:
        by_key = held.join(labels, "r").groupBy("k").agg(F.min("g").alias("g"))
        near = held.join(by_key, "k").groupBy("r").agg(F.min("g").alias("new")).join(labels, "r", "right").select("r", "g", F.least(F.coalesce("new", "g"), "g").alias("new"))
        far = labels.select(F.col("r").alias("new"), F.col("g").alias("its"))
        after = near.join(far, "new", "left").select("r", F.least("new", F.coalesce("its", "new")).alias("new"), "g").select("r", F.col("new").alias("g"), (F.col("new") < F.col("g")).alias("changed")).checkpoint()
        labels = after.select("r", "g")
        if after.filter("changed").isEmpty():
            return labels.select(F.col("r").alias(record), F.col("g").alias("group"))


def ordinals(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The n-th account of a provider, and how many it has."""
    return rows.withColumns({"ordinal": F.row_number().over(Window.partitionBy(group).orderBy(order)), "of": F.count(F.lit(1)).over(Window.partitionBy(group))})


def unique_prefix(rows: DataFrame, label: str, key: str, least: int = 6, most: int = 64) -> DataFrame:
    """The shortest prefix of a fingerprint, `least` characters at least, that tells records of one label apart."""
    prefixes = rows.select(label, key, F.explode(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(key))), lambda n: F.substring(F.col(key), F.lit(1), n))).alias("prefix"))
    alone = prefixes.groupBy(label, "prefix").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key)).filter("n = 1")
    return alone.groupBy(label, key).agg(F.min_by("prefix", F.length("prefix")).alias("prefix"))
