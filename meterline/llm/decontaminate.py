"""Benchmark decontamination: a broadcast hash set of the test items' n-grams, a scan of training windows, verified hits.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z is lower-cased. A test window is `n` consecutive words of
an item, or all words of an item with fewer. A word of a document is hit when it lies in an occurrence of a test window.

Only DataFrame functions are used. The scan hashes three words of each window (first, middle, last) and looks the hash up in
the hash set; windows that pass are compared word by word with the test windows in a broadcast join, so no hash decides a
result. Documents are never moved: only hits and one small row per document are. The set's size is counted first. Beyond
MOST_WINDOWS windows nothing is broadcast: all training windows are joined with the test windows by shuffle.

Nulls: a null text has no words, and an item without words has no window. The windows of items with a null item_id are hit as others are, but add no
item. A null doc_id returns as null. Repeated rows are
judged and returned each; items repeated with one item_id are one item. Empty tables give empty results, or documents
without hits. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
MOST_WINDOWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; pure ASCII texts take the faster way to lower case."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, GAPS), "")


def _mark(words: Column, at: Column, n: int) -> Column:
    """A hash of three words of the window of n words at `at` (from 1)."""
    return F.xxhash64(F.lit(n), F.get(words, at - 1), F.get(words, at - 1 + n // 2), F.get(words, at + (n - 2)))


def _windows(items: DataFrame, n: int) -> DataFrame:
    """The test windows: text, length, hash and the items that hold each."""
    items = items.select("item_id", words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    size = F.least(F.size("words"), F.lit(n))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - size + 1))
    items = items.select("item_id", "words", size.alias("n"), at.alias("at"))
    grams = items.select("item_id", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("gram"), F.slice("words", F.col("at"), F.col("n")).alias("window"))
    return grams.groupBy("gram", "n").agg(F.collect_set("item_id").alias("items"), F.first("window").alias("window"))


def _places(words: Column, n: int, marks: list[int] | None) -> Column:
    """Where windows of n words begin whose hash is in the set (with no set: all), with the windows' text."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    if marks is not None:
        at = F.filter(at, lambda i: _mark(words, i, n).isin(marks))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("gram")))


def _scan(words: Column, lengths: dict[int, list[int] | None]) -> Column:
    """The places of all lengths, and a null that stands for the document itself."""
    found = [_places(words, n, marks) for n, marks in sorted(lengths.items())]
    return F.concat(*found, F.array(F.lit(None).cast("struct<at:int,n:int,gram:string>")))


def find_contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Of each document: doc_id, print (a hash of its text), n_words, hits (numbers from 1 of the hit words) and items (ids of items with occurring windows)."""
    grams = _windows(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), n)
    sizes = {r["n"]: r["windows"] for r in grams.groupBy("n").agg(F.count(F.lit(1)).alias("windows")).collect()}
    lengths: dict[int, list[int] | None] = dict.fromkeys(sizes)
    small = sum(sizes.values()) <= most_windows
    if small:
        for size in sizes:
            lengths[size] = [r["m"] for r in grams.filter(F.col("n") == size).select(_mark(F.col("window"), F.lit(1), size).alias("m")).distinct().collect()]
    texts = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), words_of(F.col(text_col)).alias("words"))
    rows = texts.select("doc_id", "print", F.size("words").cast("long").alias("n_words"), F.explode(_scan(F.col("words"), lengths)).alias("hit"))
    rows = rows.select("doc_id", "print", "n_words", "hit.*")
    grams = grams.select("gram", "items")
    met = rows.join(F.broadcast(grams) if small else grams, "gram", "left")
    place = F.when(F.col("items").isNotNull(), F.sequence("at", F.col("at") + F.col("n") - 1))
    found = met.groupBy("doc_id", "print", "n_words").agg(F.count_if(F.col("at").isNull()).alias("times"), F.array_distinct(F.flatten(F.collect_list(place))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return found.select("doc_id", "print", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).drop("time")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_documents(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    found = find_contamination(documents, benchmark, id_col, text_col)
    bad = found.filter(is_contaminated(F.size("hits"), F.col("n_words"))).select(F.col("doc_id").alias("_bad_id"), F.col("print").alias("_bad_print")).distinct()
    return documents.join(bad, documents[id_col].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(documents[text_col]) == bad["_bad_print"]), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with the hit words taken out of their texts and all else as it was."""
    found = find_contamination(documents, benchmark, id_col, text_col).filter("size(hits) > 0").select("doc_id", "print", "hits").distinct()
    held = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))  # so no column's name meets another's
    joined = held.join(found, F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (F.xxhash64(f"row.`{text_col}`") == F.col("print")), "left")
    text = F.col(f"row.`{text_col}`")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    gap = lambda x: x.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    first_gap = F.when(gap(F.get(pieces, F.lit(0))), 1).otherwise(0)
    kept = F.array_join(F.filter(pieces, lambda x, i: gap(x) | ~F.array_contains(F.col("hits"), ((i - first_gap) / 2).cast("int") + 1)), "")
    new = F.when(F.col("hits").isNotNull(), kept).otherwise(text)
    return joined.select(*[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in documents.columns])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Windows of 13 words of all benchmark items in all documents."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.size("hits").cast("long")
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS gram FROM b, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS r(i) WHERE len(ws) > 0),
l AS (SELECT DISTINCT n FROM g),
s AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM d, l, unnest(range(1, len(ws) - n + 2)) AS r(i) WHERE len(ws) >= n),
h AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g ON s.n = g.n AND s.gram = g.gram),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
