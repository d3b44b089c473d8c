"""Helpers that the training-data operators share.

Text kernels work on the buffers of an Arrow string column at once: a word is a
maximal run of bytes other than 0x20 and 0x09-0x0D, never crossing a document.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Folder, checkpoint, release, shared_dir  # noqa: F401

U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
#: A-Z hash as a-z
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 2**64))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: hash of the token that ends a text
END = U64(0xE0D0C0B0A0908071)
#: bytes of text hashed at once, and rows of text handled at once
PIECE = 1 << 20
_POW = _IPOW = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        n = max(n, PIECE + 1)
        _POW = np.ones(n, dtype=np.uint64)
        _IPOW = np.ones(n, dtype=np.uint64)
        _POW[1:] = np.cumprod(np.full(n - 1, _BASE, dtype=np.uint64))
        _IPOW[1:] = np.cumprod(np.full(n - 1, _INV, dtype=np.uint64))
    return _POW, _IPOW


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True within documents, and the number of runs before each document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each document, starts, ends, bytes)."""
    data, offsets = text_buffers(column)
    starts, ends, first = runs(~IS_SPACE[data], offsets)
    out = np.empty(len(starts), np.uint64)
    table, a = _BYTE_LOWER if lower else _BYTE, 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        pw, ipw = _powers(int(e[-1]) + 1)
        prefix = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum(table[data[starts[a] : ends[b - 1]]] * pw[: e[-1]], out=prefix[1:])
        out[a:b] = (prefix[e] - prefix[s]) * ipw[s]
        a = b
    return mix(out), first, starts, ends, data


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens that end at each position (positions below n - 1 are not meaningful)."""
    pw, ipw = _powers(len(tokens) + 1)
    prefix = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * pw[: len(tokens)], out=prefix[1:])
    out = np.zeros(len(tokens), np.uint64)
    if len(tokens) >= n:
        out[n - 1 :] = mix((prefix[n:] - prefix[:-n]) * ipw[: len(tokens) - n + 1] + U64(n))
    return out


class Spans:
    """Hashes of spans of tokens, whose running sum is made once."""

    def __init__(self, tokens: np.ndarray):
        pw, self.ipw = _powers(len(tokens) + 1)
        self.prefix = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * pw[: len(tokens)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of the tokens start .. start + length - 1 of each span; equal to that of gram_hashes for equal tokens."""
        out = self.prefix[start + length]
        out -= self.prefix[start]
        out *= self.ipw[start]
        out += length.astype(np.uint64)
        return mix(out)


def span_hashes(tokens: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return Spans(tokens)(start, length)


def lend_large() -> None:
    """Has very large arrays mapped one by one, so that each goes back to the system when it is freed; those of a block stay in the heap,
    whose end goes back beyond 64 MB, as mapping their pages again and again takes long."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD; a set one no longer grows
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # not a glibc system
        pass


def trim() -> None:
    """Gives freed memory back to the system; Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a glibc system
        pass


def pieces(batches, text: str = "text", most: int = 6 << 20):
    """Record batches cut so that each holds about `most` bytes of text (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(text))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    trim()


def row_key(columns: list[str]) -> Column:
    """128 hash bits of a row; which columns are null counts."""
    both = lambda: [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit("a"), *both()).alias("a"), F.xxhash64(F.lit("b"), *both()).alias("b"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): (id, component), the component being the smallest id.

    Alternating large-star and small-star steps; each round is checkpointed. Rows of the result are the
    ids that have an edge to another id. No neighbourhood is ever collected: each step is an aggregate
    and a join.
    """
    spark = edges.sparkSession
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour of u points to the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpoint(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark)
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("id"), "component").distinct())
