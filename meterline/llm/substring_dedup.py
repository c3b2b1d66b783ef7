"""Substring deduplication by seed and extend.

A window is `window` consecutive words of a document. A word is removed when some window over it has a word sequence that
also starts earlier (smaller doc_id, or the same document, earlier start). Windows are judged on the input.

1. Seeds: winnowing picks in every window its least `seed`-word fingerprint as anchor. Equal windows pick equal anchors at
   equal offsets, so windows that are equal meet at an anchor. About one word in eight is an anchor.
2. Anchors that occur once are dropped after a map-side combined count. Each other anchor knows its earliest occurrence.
3. Extension: every occurrence is extended over the windows that picked it, both ways, and compared with the earliest
   occurrence of its anchor. Most of a repeated passage is settled here, in one row an anchor, however hot the passage.
4. Windows that differ from those of the earliest occurrence (the edges of a passage) meet again by fingerprint of the
   whole window; the earliest one of each stays.
5. Overlapping windows merge into maximal repeats, and these are cut from the documents.

Two windows count as equal when anchor and window agree in two independent 64-bit fingerprints. No group is gathered into
one task: hot anchors meet in joins whose large partitions adaptive execution splits, and in sums combined before the shuffle.

Nulls: a null text has no words; a document with a null doc_id has no place in the order, so it loses no words and takes
none. Rows repeated with the same doc_id and text are one document, and each is returned. Empty tables give empty results. Only the id, text and `carry`
columns are read; others, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, ship

ship(__name__)

WINDOW, SEED = 20, 6


def _anchors_of(words, window: int, seed: int):
    """The anchor (as a word number) of each window that lies in one document, those windows' starts, and seed fingerprints."""
    import numpy as np

    grams = words.grams(seed, K.BASES[1])
    low = K.U(0xFFFFFF)
    place = np.arange(len(grams), dtype=K.U)
    least = K.sliding_min((grams & ~low) | (place & low), window - seed + 1)
    starts = np.flatnonzero(words.whole(window))
    at = starts + ((least[starts] & low).astype(np.int64) - starts & 0xFFFFFF) if len(starts) else starts
    return at, starts, grams


def _find(window: int, seed: int):
    def find(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.Words(part.column("text"))
                at, _, grams = _anchors_of(words, window, seed)
                at = np.unique(at)
                doc = words.doc[at]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(ids[doc]), pa.array((at - words.first[doc]).astype(np.int32))], ["seed", "doc_id", "place"])

    return find


def _pack(batches):
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        packed = pa.array([press.compress((x or "").encode()) for x in batch.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([packed if i == at else x for i, x in enumerate(batch.columns)], batch.schema.names)


def _unpacked(batches, most: int = K.SLICE_BYTES):
    """Batches of about `most` bytes of unpacked text."""
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        got, size, first = [], 0, 0
        for i, packed in enumerate(batch.column(at)):
            got.append(press.decompress(packed.as_py()).decode())
            size += len(got[-1])
            if size >= most or i + 1 == batch.num_rows:
                part = batch.slice(first, len(got))
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()) if j == at else x for j, x in enumerate(part.columns)], batch.schema.names)
                got, size, first = [], 0, i + 1


def packed(documents: DataFrame) -> DataFrame:
    """The documents with their texts compressed, for a shuffle of under half the bytes."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([StructField(f.name, BinaryType() if f.name == "text" else f.dataType) for f in documents.schema])
    return documents.mapInArrow(_pack, schema)


def _extend(window: int, seed: int):
    """For each anchor that repeats: the windows that picked it, as starts and fingerprints."""

    def extend(batches):
        import numpy as np
        import pyarrow as pa

        for part in _unpacked(batches):
            words = K.Words(part.column("text"))
            at, starts, grams = _anchors_of(words, window, seed)
            hashes = words.grams(window, K.BASES[2])
            lists = part.column("places")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            doc = np.repeat(np.arange(part.num_rows), sizes)
            wanted = words.first[doc] + flat.field("place").to_numpy()
            order = np.argsort(wanted, kind="stable")
            wanted, doc = wanted[order], doc[order]
            earliest = flat.field("earliest").to_numpy(zero_copy_only=False)[order]
            slot = np.searchsorted(wanted, at)
            hit = slot < len(wanted)
            hit[hit] = wanted[slot[hit]] == at[hit]
            starts, slot = starts[hit], slot[hit]
            order = np.argsort(slot, kind="stable")
            starts, slot = starts[order], slot[order]
            bounds = pa.array(np.searchsorted(slot, np.arange(len(wanted) + 1)).astype(np.int32))
            owner = doc[slot]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[wanted].view(np.int64)), pa.array(ids[doc]), pa.array(earliest, pa.bool_()),
                    pa.ListArray.from_arrays(bounds, pa.array((starts - words.first[owner]).astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(hashes[starts].view(np.int64))),
                ],
                ["seed", "doc_id", "earliest", "starts", "windows"],
            )

    return extend


def _cut_out(window: int, keep_unchanged: bool):
    def cut_out(batches):
        import numpy as np
        import pyarrow as pa

        for part in _unpacked(batches):
            texts = part.column("text")
            words = K.Words(texts)
            lists = part.column("starts")
            sizes = np.diff(lists.offsets.to_numpy())
            first = words.first[np.repeat(np.arange(part.num_rows), sizes)] + lists.flatten().to_numpy()
            gone = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(gone, first, 1)
            np.add.at(gone, first + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (words.count > 0) if part.num_rows else words.count
            data, kept = words.data.tobytes(), []
            for i in range(part.num_rows):
                a, b = words.first[i], words.first[i + 1]
                if keep_unchanged and not removed[i]:
                    kept.append(texts[i].as_py())
                else:
                    pick = a + np.flatnonzero(~gone[a:b])
                    kept.append(b" ".join([data[x:y] for x, y in zip(words.start[pick].tolist(), words.end[pick].tolist())]).decode())
            columns = {x: part.column(x) for x in part.schema.names if x not in ("starts", "text")}
            columns |= {"n_words": pa.array(words.count.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return cut_out


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), window: int = WINDOW, seed: int = SEED, keep_unchanged: bool = False) -> DataFrame:
    """The documents without the words that an earlier equal window covers.

    Returns doc_id, the `carry` columns, n_words, n_removed and kept_text: the kept words joined by one space, or with
    keep_unchanged the text as it was where no word goes.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    if not 1 <= seed <= window:
        raise ValueError("a seed has at least one word and no more than a window")
    documents = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    texts = documents.select("doc_id", "text").filter("doc_id is not null")
    anchors = texts.mapInArrow(_find(window, seed), "seed long, doc_id long, place int")
    # A join of two plain shuffles is one whose hot partitions can be split, so sums are written before they are joined.
    repeated = cut(anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place")).alias("least")).filter("n > 1").select("seed", "least"), "anchors")
    met = anchors.join(repeated, "seed").select("doc_id", F.struct("place", (F.struct("doc_id", "place") == F.col("least")).alias("earliest")).alias("one"))
    places = met.groupBy("doc_id").agg(F.collect_set("one").alias("places"))
    extended = packed(texts).join(places, "doc_id").mapInArrow(_extend(window, seed), "seed long, doc_id long, earliest boolean, starts array<int>, windows array<long>")
    earliest = extended.filter("earliest").select("seed", F.col("windows").alias("known"))  # one row a seed
    pairs = F.arrays_zip("starts", "windows")
    settled = (
        extended.filter("not earliest")
        .join(earliest, "seed")
        .select("seed", "doc_id", F.transform(F.filter(pairs, lambda x: F.array_contains(F.col("known"), x["windows"])), lambda x: x["starts"]).alias("gone"), F.filter(pairs, lambda x: ~F.array_contains(F.col("known"), x["windows"])).alias("open"))
    )
    settled = cut(settled, "extended")
    edges = settled.select("seed", "doc_id", F.explode("open").alias("one")).select("seed", "doc_id", F.col("one.starts").alias("start"), F.col("one.windows").alias("hash"))
    first = cut(edges.groupBy("seed", "hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("least")).filter("n > 1").drop("n"), "edges")
    later = edges.join(first, ["seed", "hash"]).filter(F.struct("doc_id", "start") > F.col("least")).select("doc_id", F.array("start").alias("gone"))
    gone = settled.filter("size(gone) > 0").select("doc_id", "gone").unionByName(later).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("starts"))
    joined = packed(documents).join(gone, "doc_id", "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))
    schema = StructType([f for f in joined.schema if f.name not in ("starts", "text")] + [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    out = joined.mapInArrow(_cut_out(window, keep_unchanged), schema)
    return out.select("doc_id", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], "n_words", "n_removed", "kept_text")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 20 words over all documents; the kept words as a digest."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS seq FROM w, unnest(range(1, len(ws) - 18)) AS r(i) WHERE len(ws) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE nth > 1),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.j) AS kept, count(*) AS n_kept FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
