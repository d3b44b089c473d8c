"""Byte-level BPE encoding and decoding by a two-tier lookup.

Each match of the splitting pattern is looked up whole through a minimal perfect hash of the vocabulary; what is not
in it is merged by rank with a heap over linked bytes. The vocabulary is a fixed file of ranks, read on every executor
from its path or shipped as a broadcast (its size doesn't depend on the data). A bounded cache keeps recent matches.

Defined results: a null text is empty and has no ids; texts are encoded whole; repeated rows are encoded alike; a null
doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, trim

_M64 = (1 << 64) - 1
_SHIFT = 40


class MinimalPerfectHash:
    """Hash and displace: n keys to 0..n-1 without gaps. A key outside the set gets some place, so holders compare keys."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("keys are repeated or their hashes collide")
        for h in hashes:
            groups[h % self.buckets].append(h)
        self.displace = [0] * self.buckets
        free = np.ones(n, bool)
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        singles = [b for b in order if len(groups[b]) == 1]
        for b in order:
            if len(groups[b]) < 2:
                break
            d = 1
            while True:
                places = [self._place(h, d) for h in groups[b]]
                if len(set(places)) == len(places) and all(free[p] for p in places):
                    break
                d += 1
            free[places] = False
            self.displace[b] = d
        for b, p in zip(singles, np.flatnonzero(free).tolist()):
            self.displace[b] = -p - 1

    def _place(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & _M64
        return (x >> 32) * self.n >> 32

    def __call__(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        return -d - 1 if d < 0 else self._place(h, d)


class Tokenizer:
    """Ranks of a byte-level BPE. encode gives ids; decode gives bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 300_000):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must hold every single byte")
        self.token = {i: b for b, i in ranks.items()}
        self.pattern, self.cache_size = pattern, cache
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.slots: list[tuple[bytes, int]] = [(b"", 0)] * len(keys)
        for k in keys:
            self.slots[self.hash(k)] = (k, ranks[k])
        self.byte = [ranks[bytes([b])] for b in range(256)]
        #: the merge of two tokens, by left << 32 | right
        self.pair = {ranks[k[:i]] << 32 | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self._reset()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _reset(self) -> None:
        self._find = regex.compile(self.pattern).findall
        self._bytes = {str(i): b for i, b in self.token.items()}
        self._cache = _Cache(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_find", "_cache", "_bytes")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def whole(self, match: bytes) -> int | None:
        """First tier: the id of a match that is itself a token."""
        key, rank = self.slots[self.hash(match)]
        return rank if key == match else None

    def merge(self, match: bytes) -> list[int]:
        """Second tier: the pair of least rank, leftmost first, is merged until none is left."""
        n, get = len(match), self.pair.get
        ids = [self.byte[b] for b in match]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append(r << _SHIFT | i)
        heapq.heapify(heap)
        pop, push, low = heapq.heappop, heapq.heappush, (1 << _SHIFT) - 1
        while heap:
            x = pop(heap)
            r, i = x >> _SHIFT, x & low
            if ids[i] < 0:
                continue
            j = after[i]
            if j >= n or get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = get(r << 32 | ids[k])
                if s is not None:
                    push(heap, s << _SHIFT | i)
            k = before[i]
            if k >= 0:
                s = get(ids[k] << 32 | r)
                if s is not None:
                    push(heap, s << _SHIFT | k)
        return [x for x in ids if x >= 0]

    def encode_match(self, match: bytes) -> list[int]:
        one = self.whole(match)
        return self.merge(match) if one is None else [one]

    def encode_decimal(self, text: str) -> str:
        """The ids as decimals, joined by a blank."""
        cache = self._cache
        if len(cache) > self.cache_size:
            cache.turn()
        return " ".join([cache[m] for m in self._find(text)])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_decimal(text).split()]

    def forget(self) -> None:
        self._cache.drop()
        trim()

    def decode_decimal(self, ids: str) -> bytes:
        of = self._bytes
        return b"".join([of[x] for x in ids.split(" ")]) if ids else b""

    def decode(self, ids) -> bytes:
        return b"".join(self.token[i] for i in ids)


class _Cache(dict):
    """Two generations: what was used since the last turn, and what the turn before kept."""

    def __init__(self, owner: Tokenizer):
        super().__init__()
        self.owner, self.older = owner, {}

    def drop(self) -> None:
        self.clear()
        self.older = {}

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, match: str) -> str:
        found = self.older.get(match)
        if found is None:
            found = " ".join(map(str, self.owner.encode_match(match.encode())))
        self[match] = found
        return found


_loaded: dict[tuple[str, str], Tokenizer] = {}


def load(path: str, pattern: str) -> Tokenizer:
    """One tokenizer a process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer.from_file(path, pattern)
    return _loaded[path, pattern]


def _texts(batches):
    for batch in pieces(batches, most=2 << 20):
        yield batch, ["" if x is None else x for x in batch.column("text").to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>"

    def run(batches):
        t = load(path, pattern)
        try:
            for batch, texts in _texts(batches):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.encode(x) for x in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        finally:
            t.forget()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data binary: the bytes of the ids; null ids are empty."""
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary"

    def run(batches):
        t = load(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, in one pass over the texts."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        t = load(path, pattern)
        try:
            for batch, texts in _texts(batches):
                n, ids_hex, data_hex = [], [], []
                for x in texts:
                    ids = t.encode_decimal(x)
                    n.append(ids.count(" ") + 1 if ids else 0)
                    ids_hex.append(sha256(ids.encode()).hexdigest())
                    data_hex.append(sha256(t.decode_decimal(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(data_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            t.forget()  # workers live on between stages

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
