"""Flat exports and budgeted payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_rows(rollup: DataFrame) -> DataFrame:
    """Long rows: period, dimension (tool or model), name, tokens, cost (B1)."""
    part = lambda c, name: rollup.groupBy("period", F.lit(name).alias("dimension"), F.col(c).alias("name")).agg(F.sum("total").cast("long").alias("tokens"), F.sum("cost_nano").cast("long").alias("cost_nano"))
    return part("client", "tool").unionByName(part("model", "model"))


def csv_field(value: Column) -> Column:
    """A field quoted if it has a quote, comma or line end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with CRLF line ends (B3, B5: the folder's old files go)."""
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def json_document(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Rows as one JSON array, for results of a report's size."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in order])))).alias(name))


def budgeted(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix in order whose sizes fit the budget."""
    over = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes", size).withColumn("bytes_so_far", F.sum("bytes").over(over)).filter(F.col("bytes_so_far") <= budget)


def pruned(days: DataFrame, cutoff: Column, columns: Sequence[str]) -> DataFrame:
    """Detail columns only from the cutoff on."""
    return days.withColumns({c: F.when(F.col("day") >= cutoff, F.col(c)) for c in columns})


def public(rows: DataFrame, private: Sequence[str]) -> DataFrame:
    """Rows without identifying columns."""
    return rows.drop(*private)
