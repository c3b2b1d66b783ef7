"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut
out, documents with benchmark passages go, and the rest is mixed to target weights.

Each stage works on all documents that the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import decontaminate, mixing, near_dedup, substring_dedup, toxicity
from meterline.llm.common import cut

COLUMNS = ("text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of rejection."""
    learned = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, *learned, carry=COLUMNS).filter(F.col("score") < toxicity.REJECT).drop("score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id."""
    found = near_dedup.components(docs)
    others = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select("doc_id", *COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages (20 words or more) that an earlier document or place has."""
    found = substring_dedup.remove_repeats(docs, carry=("lang", "source"), keep_unchanged=True)
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark passages."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", *COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the rates that bring the expected domain totals to the targets."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: No SQL expresses a learned classifier, so the whole has no SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
