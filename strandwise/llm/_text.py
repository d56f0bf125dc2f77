"""Vectorised word and shingle hashing over Arrow string columns.

Every function works on whole texts, in blocks of bounded size, and treats a
null as the empty text.  A word is identified by a 64-bit hash: its bytes are
taken eight at a time, each eight is mixed with its place, and the sum is mixed
with the length.  Words of the same length of up to eight bytes never collide;
others do as random numbers would, so a table of 10^7 distinct words holds a
collision with odds of about 3 in a million.  Where that isn't enough a second
hash, of another seed, is compared as well.  Only pieces of fixed small length
(n-grams, vocabulary pieces) use the polynomial of :func:`substring_hashes`.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, of an array (numpy warns of wrapping scalars)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def released(run: Callable) -> Callable:
    """A function over Arrow batches after whose end the worker gives freed memory back to the system.

    Spark keeps idle workers for later stages; else each holds on to the most that it ever took.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return wrapped


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_VALUE = stream(11, 256)
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, BLOCK + 64)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        _POW = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE)]))
        _INV = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, inverse)]))
    return _POW, _INV


class WordClass:
    """Which bytes make up words, after A-Z are lower-cased (unless ``fold`` is false)."""

    def __init__(self, separators: bytes, fold: bool = True):
        self.lower = np.arange(256, dtype=np.uint8)
        if fold:
            self.lower[65:91] += 32
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False


#: [^\x20\x09-\x0D]+
SPACED = WordClass(b" \t\n\x0b\x0c\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = WordClass(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


class Words(NamedTuple):
    hash: np.ndarray  # uint64, a value for each word
    start: np.ndarray  # byte offsets into the data
    end: np.ndarray
    doc_at: np.ndarray  # words of document d: doc_at[d] .. doc_at[d + 1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def spans(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cut(data: np.ndarray, at: int, is_word: np.ndarray, lower: np.ndarray) -> int:
    """The end of the block from ``at``: never inside a word."""
    end = min(len(data), at + BLOCK)
    if end == len(data) or not is_word[lower[data[end]]]:
        return end
    gaps = np.flatnonzero(~is_word[lower[data[at:end]]])
    if len(gaps):
        return at + int(gaps[-1]) + 1
    while end < len(data):
        gaps = np.flatnonzero(~is_word[lower[data[end : end + BLOCK]]])
        if len(gaps):
            return end + int(gaps[0])
        end = min(len(data), end + BLOCK)
    return end


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_GOLD, _SIZE = np.array([0x9E3779B97F4A7C15], U64), np.array([0xD6E8FEB86659FD93], U64)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes start..end of each run."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    # the eight bytes from every place on, without a copy
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    many = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(many) - many
    step = np.arange(int(many.sum())) - np.repeat(first, many)
    x = eight[np.repeat(start, many) + 8 * step] & _KEEP[np.minimum(np.repeat(size, many) - 8 * step, 8)]
    x = mix(x + (step.astype(U64) + U64(1 + (seed << 32))) * _GOLD)
    return mix(np.add.reduceat(x, first) + size.astype(U64) * _SIZE)


def words(data: np.ndarray, off: np.ndarray, kind: WordClass = SPACED, seed: int = 0) -> Words:
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        end = _cut(data, at, kind.is_word, kind.lower)
        low = kind.lower[data[at:end]]
        inside = kind.is_word[low]
        heads = off[np.searchsorted(off, at, "right") : np.searchsorted(off, end, "left")] - at
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[heads - 1] = inside[heads - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(run_hashes(low, s, e, seed))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(off), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, off))


_STEP = stream(23, 64) | U64(1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and each document's offsets in them.

    A document with fewer words, but not none, has its whole sequence as one.
    """
    n = len(w.hash)
    count = np.diff(w.doc_at)
    short = (count > 0) & (count < size)
    runs = np.where(short, 1, np.maximum(count - size + 1, 0))
    at = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(at[-1], U64)
    if n >= size:
        full = w.hash[: n - size + 1] * _STEP[0]
        for j in range(1, size):
            full = full + w.hash[j : n - size + 1 + j] * _STEP[j]
        long = ~short & (count > 0)
        first = np.repeat(w.doc_at[:-1][long] - at[:-1][long], runs[long])
        put = np.repeat(long, runs)
        pos = np.flatnonzero(put)
        out[pos] = mix(full[pos + first])
    for d in np.flatnonzero(short):
        own = w.hash[w.doc_at[d] : w.doc_at[d + 1]]
        out[at[d] : at[d] + 1] = mix((own * _STEP[: len(own)]).sum(dtype=U64, keepdims=True) + np.array([len(own)], U64) * _STEP[60:61])
    return out, at


def per_document(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x over each document's part, for parts that may be empty."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
    return total[at[1:]] - total[at[:-1]]


def distinct_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct word in ``w``, and each word's number among them."""
    _, place, number = np.unique(w.hash, return_index=True, return_inverse=True)
    return place, number


def substring_hashes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over a matrix of bytes, from which :func:`piece_hash` takes any substring's hash."""
    up, _ = _powers(rows.shape[1] + 1)
    total = np.zeros((rows.shape[0], rows.shape[1] + 1), U64)
    np.cumsum(_VALUE[rows] * up[: rows.shape[1]], axis=1, out=total[:, 1:])
    return total, rows


def piece_hash(total: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The hash of bytes start..stop of each row."""
    _, down = _powers(total.shape[1])
    return mix((total[:, stop] - total[:, start]) * down[start : start + 1] ^ U64((stop - start) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def bytes_hash(piece: bytes) -> int:
    total, _ = substring_hashes(np.frombuffer(piece, np.uint8)[None, :])
    return int(piece_hash(total, 0, len(piece))[0])


def crc_fold(column, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string").cast("binary")) % folds


def sample_texts(rows, per_class: int) -> list[tuple[str, str]]:
    """(class, text) of at most ``per_class`` rows of each class, chosen by a hash of the id.

    ``rows`` has id, label and text; the limit is applied in each task before
    rows meet, so a class may hold any share of them.
    """
    from pyspark.sql import Window, functions as F

    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    ids = rows.select("id", "label").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class).select("id").distinct()
    ids = [r["id"] for r in ids.collect()]
    picked = rows.where(F.col("id").isin(ids)) if ids else rows.limit(0)
    return sorted(((str(r["label"]), r["text"]) for r in picked.select("label", "text").toLocalIterator()))


def segment_hashes(data: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the bytes between consecutive bounds, which cover all of the data."""
    out = np.empty(len(bounds) - 1, U64)
    i = 0
    while i < len(out):
        j = min(len(out), max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1))
        out[i:j] = run_hashes(data[bounds[i] : bounds[j]], bounds[i:j] - bounds[i], bounds[i + 1 : j + 1] - bounds[i], seed)
        i = j
    return out
