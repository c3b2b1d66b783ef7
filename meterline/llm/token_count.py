"""Token counts of whole texts, as the tokenizer library gives them.

An Arrow function returns lengths only. A byte-level tokenizer cuts a text into pieces by a fixed pattern and encodes each
piece alone, so a text's length is the sum of its pieces' lengths. Each worker keeps the lengths of pieces that it has met
and asks the library for the others, one batch of missing pieces at a time. Batches are balanced by bytes, and a text
longer than a batch is split before a single space between two other characters, where the pattern always cuts too.
Tokenizers of any other kind, and texts with characters whose class the pattern's two implementations might judge
differently, go to the library whole.

A null text has no tokens. A null doc_id returns as null; repeated rows are counted each. Only the id and text columns are
read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import process_cache, ship

ship(__name__)

BATCH_BYTES = 1 << 20
#: Pieces whose lengths a worker keeps; beyond, it starts anew.
KEPT_PIECES = 1 << 20
#: Letters, numbers and spaces among the characters that the pattern below judges by itself; texts with others go to the library whole.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
COMMON = r"[^\t-\r -~\x85\xa0-ɏ‐-‧‰-⁞₠-₿]"
#: The fixed pattern of byte-level tokenizers of this family.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def _byte_level(path: str) -> list[str] | None:
    """The strings of added tokens if a JSON tokenizer encodes each of PIECES alone, else None."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
    added = spec.get("added_tokens") or []
    if not plain or spec.get("truncation") or spec.get("padding") or (spec.get("model") or {}).get("dropout") or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
        return None
    return [x["content"] for x in added]


def _parts(text: str, most: int) -> list[str]:
    """A long text in parts of about `most` characters, each cut before a single space between two other characters."""
    import re

    if len(text) <= most:
        return [text]
    safe, out, at = re.compile(r"(?<=\S) (?=\S)"), [], 0
    while len(text) - at > most:
        found = safe.search(text, at + most)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def _counter(path: str):
    """A function from a list of texts to the list of their numbers of tokens."""
    import os

    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    whole = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    added = _byte_level(path)
    if added is None:
        return whole
    import re

    pieces, odd = re.compile(PIECES).findall, re.compile(COMMON).search
    kept: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        strange = [i for i, x in enumerate(texts) if any(a in x for a in added) or odd(x)]
        skip = set(strange)
        cut = [() if i in skip else pieces(x) for i, x in enumerate(texts)]
        missing = list(set().union(*cut) - kept.keys())
        if len(kept) + len(missing) > KEPT_PIECES:
            kept.clear()
            missing = list(set().union(*cut))
        kept.update(zip(missing, whole(missing)))
        out = [sum(map(kept.__getitem__, x)) for x in cut]
        for i, n in zip(strange, whole([texts[i] for i in strange])):
            out[i] = n
        return out

    return count


def _count(path: str):
    def count(batches):
        import pyarrow as pa

        counters = process_cache("token counters")
        if path not in counters:
            counters[path] = _counter(path)
        counter = counters[path]
        splits = not path.endswith(".model") and _byte_level(path) is not None
        for batch in batches:
            for part in K.slices(batch, "text", BATCH_BYTES):
                texts = [x or "" for x in part.column("text").to_pylist()]
                sizes = [len(x.encode()) for x in texts]
                totals = []
                for text, size in zip(texts, sizes):
                    if size > BATCH_BYTES and splits:
                        totals.append(sum(counter([x])[0] for x in _parts(text, BATCH_BYTES)))
                if not totals:
                    totals = counter(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def count_tokens(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Of each document: doc_id, n_bytes (UTF-8), n_tokens by the tokenizer file, and over_limit."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_count(tokenizer), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_count(spark, sf_dir: str) -> DataFrame:
    """The tokens of every document by the byte-level vocabulary of 50 thousand."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
