"""NumPy kernels over Arrow string buffers: words, rolling fingerprints and per-document reductions.

All fingerprints are functions of the text alone, the same in every process. A sequence of words has a 64-bit
polynomial fingerprint for each of two independent bases; where equality decides a result, both are compared (128 bits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import process_cache, ship

ship(__name__)

U = np.uint64
SLICE_BYTES = 1 << 20

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x9FB21C651E98DF25)


#: Powers that a process keeps of each base (16 bytes each); longer slices make theirs anew.
KEPT_POWERS = 1 << 21


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    kept = process_cache("powers")
    if base in kept and len(kept[base][0]) >= n:
        return kept[base]
    size = (n // (1 << 16) + 1) << 16
    one = np.full(size, base, U)
    one[0] = 1
    back = np.full(size, pow(base, -1, 1 << 64), U)
    back[0] = 1
    made = np.cumprod(one, dtype=U, out=one), np.cumprod(back, dtype=U, out=back)
    if size <= KEPT_POWERS:
        kept[base] = made
    return made


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Fingerprints of values[start:end], equal for equal sequences at whatever place."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


class Words:
    """The words of a slice of documents. start, end: byte places; doc: the document's number; first: each document's first word, and the end."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = ASCII_SPACE, fold: bool = False):
        self.data, self.offsets = buffer(texts)
        data = FOLD[self.data] if fold else self.data
        word = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], word[:-1])) if len(word) else word
        after = np.concatenate((word[1:], [False])) if len(word) else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = spans(BYTE_VALUE[data], self.start, self.end, BASES[0])

    def grams(self, n: int, base: int) -> np.ndarray:
        """The fingerprint of the n words from each word on; where they leave the slice, 0."""
        out = np.zeros(len(self.hash), U)
        if len(self.hash) >= n:
            at = np.arange(len(self.hash) - n + 1)
            out[: len(at)] = spans(self.hash, at, at + n, base)
        return out

    def whole(self, n: int) -> np.ndarray:
        """Of each word: do the n words from it on lie in its document?"""
        return np.arange(len(self.hash)) + n <= self.first[1:][self.doc]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, nulls as empty, and the offsets of its members."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Slices of a batch with at most about `most` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
