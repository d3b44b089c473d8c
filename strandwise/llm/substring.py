"""Substring deduplication with suffix automata of reference shards.

`remove_known` is the plain form: automata of a bounded reference are broadcast shard by shard, documents are streamed
through them for matching statistics, and maximal spans of at least `n` words that occur in the reference are removed.

`deduplicate` does it for a corpus against itself: a word goes if a window of n words that covers it starts earlier
elsewhere. Streaming every document through the automata of all others would be quadratic, so windows are first
routed: the key of a window is the least hash of its n/2-word grams, a function of its words alone, and equal windows
have equal keys. A document is cut into runs of windows with one key.

1. Runs with equal words: all but the first (by document and start) go whole. Runs of one task that repeat are decided
   there, so a passage that a third of all rows share sends a row a batch.
2. Where runs with one key differ, the first of each different run is a reference of that key's shard: in order, it is
   streamed through the shard's automaton for matching statistics, and then added to it.
3. A key with more than `shard_runs` different runs is split by the hash of single windows instead.

Defined results: a null or empty text has no words; a null doc_id comes after all others; rows with one doc_id are at one
place, so a repeated row is not earlier than its like; texts of fewer than n words stay whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, gram_hashes, pieces, release, span_hashes, word_hashes

RUN = 11
LAST = 2**63 - 1


class SuffixAutomaton:
    """Of any number of sequences; positions are not kept."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, tokens) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def statistics(self, tokens) -> list[int]:
        """For each token the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in tokens:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is None:
                size = 0
            else:
                state = to
                size += 1
            out.append(size)
        return out


def window_keys(words: np.ndarray, n: int) -> np.ndarray:
    """The key of the window that starts at each word, where it fits: the least hash of its grams of n // 2 words."""
    m = n // 2
    grams = gram_hashes(words, m)[m - 1 :]
    wide = n - m + 1
    return np.lib.stride_tricks.sliding_window_view(grams, wide).min(axis=1) if len(grams) >= wide else np.zeros(0, np.uint64)


def _window_runs(words: np.ndarray, first: np.ndarray, n: int):
    """(document, start in the document, windows, key, hash of the run's words) of all runs of the texts."""
    count = np.diff(first)
    if len(words) < n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    keys = window_keys(words, n)
    doc = np.repeat(np.arange(len(count)), count)[: len(keys)]
    place = np.arange(len(keys)) - first[doc]
    at = np.flatnonzero(place + n <= count[doc])
    key, d, s = keys[at], doc[at], place[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    new = since % RUN == 0
    run = np.cumsum(new) - 1
    window = gram_hashes(words, n)[at + n - 1]
    recurs = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
    for p in range(1, RUN):
        recurs[run[p:][(window[p:] == window[:-p]) & (run[p:] == run[:-p])]] = True
    # a run in which a window recurs can't be decided as a whole: its windows are runs of their own
    head = np.flatnonzero(new | recurs[run])
    size = np.diff(np.append(head, len(at)))
    return d[head], s[head], size, key[head], span_hashes(words, at[head], size + n - 1)


def _removed_runs(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Runs that go whole (key, start, size), and the first of each run whose key has different ones (gram, place, key, start, size)."""

    def cut(batches):
        for batch in pieces(batches):
            words, first, *_ = word_hashes(batch.column("text"), lower=False)
            d, start, size, gram, whole = _window_runs(words, first, n)
            if not len(d):
                continue
            place, key = batch.column("place").to_numpy()[d], batch.column("key").to_numpy()[d]
            order = np.lexsort((key, start, place, whole, gram))
            d, start, size, gram, whole, place, key = (x[order] for x in (d, start, size, gram, whole, place, key))
            new = np.ones(len(d), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])
            head = np.flatnonzero(new)
            of = np.repeat(head, np.diff(np.append(head, len(d))))
            local = (place[of] != place) | (start[of] != start)  # an equal run of this batch is earlier
            yield from _slices([gram.view(np.int64), whole.view(np.int64), place, key, start, size, local], ["gram", "whole", "place", "key", "start", "size", "gone"], [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()])

    schema = "gram long, whole long, place long, key long, start int, size int, gone boolean"
    # decided rows only pass through, wherever they go
    rows = docs.mapInArrow(cut, schema).repartition("gram").sortWithinPartitions("gram", "whole", "place", "start", "key")

    def judge(batches):
        gram = whole = at = held = None
        many = False
        names, kinds = ["gram", "place", "key", "start", "size", "gone"], [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_()]
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "whole", "place", "key", "start", "size", "gone")]
            g, w = cols[0], cols[1]
            # rows whose key is theirs alone are nearly all: they go at once
            same = np.zeros(len(g) + 1, bool)
            same[1:-1] = g[1:] == g[:-1]
            alone = ~same[:-1] & ~same[1:]
            alone[[0, -1]] = False
            out = []
            for gram_, whole_, place, key, start, size, local in zip(*(c[~alone].tolist() for c in cols)):
                if gram_ != gram:
                    gram, whole, many, held = gram_, None, False, []
                if whole_ != whole:
                    many = whole is not None
                    whole, at = whole_, (place, start)
                    if many:
                        out += held
                        held = []
                row = (gram_, place, key, start, size)
                if local or (place, start) != at:
                    out.append((*row, True))
                elif many:
                    out.append((*row, False))
                else:
                    held.append((*row, False))
            if out:
                yield from _slices(list(zip(*out)), names, kinds)

    judged = checkpoint(rows.mapInArrow(judge, "gram long, place long, key long, start int, size int, gone boolean"))
    return judged.where("gone").select("key", "start", "size"), judged.where("NOT gone").drop("gone")


def _slices(columns, names, kinds, most: int = 200_000):
    for a in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + most], k) for c, k in zip(columns, kinds)], names=names)


def removed_windows(docs: DataFrame, n: int = 20, shard_runs: int = 2000) -> DataFrame:
    """(key, start, size): runs of windows whose words start earlier elsewhere; key is that of `keyed`."""
    spark = docs.sparkSession
    gone, differ = _removed_runs(docs, n)
    release(spark)
    hot = differ.groupBy("gram").count().where(F.col("count") > shard_runs).select("gram", F.lit(True).alias("hot"))
    differ = differ.join(hot, "gram", "left")
    asked = differ.groupBy("key").agg(F.collect_list(F.struct("gram", "place", "start", "size", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))

    def fetch(batches):
        names, kinds = ["gram", "place", "key", "start", "size", "words"], [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
        for batch in pieces(batches):
            words, first, starts, ends, data = word_hashes(batch.column("text"), lower=False)
            out = []
            for i, (key, runs) in enumerate(zip(batch.column("key").to_pylist(), batch.column("runs").to_pylist())):
                for r in runs:
                    a = int(first[i]) + r["start"]
                    if r["hot"]:
                        for k in range(r["size"]):
                            whole = gram_hashes(words[a + k : a + k + n], n)[-1:].view(np.int64)[0]
                            out.append((int(whole), r["place"], key, r["start"] + k, 1, b""))
                    else:
                        out.append((r["gram"], r["place"], key, r["start"], r["size"], data[starts[a] : ends[a + r["size"] + n - 2]].tobytes()))
            if out:
                yield from _slices(list(zip(*out)), names, kinds, 20_000)

    schema = "gram long, place long, key long, start int, size int, words binary"
    once = docs.select("key", "text").join(asked.hint("merge"), "key")
    runs = once.mapInArrow(fetch, schema).repartition("gram").sortWithinPartitions("gram", "place", "start", "key")

    def stream(batches):
        names, kinds = ["key", "start", "size"], [pa.int64(), pa.int32(), pa.int32()]
        gram = automaton = at = None
        waiting: list = []  # runs at the place now read: none is earlier than another
        for b in batches:
            out = []
            for g, place, key, start, size, raw in zip(*(b.column(c).to_pylist() for c in ("gram", "place", "key", "start", "size", "words"))):
                if g != gram:
                    gram, automaton, at, waiting = g, SuffixAutomaton(), None, []
                if not raw:  # a single window: all but the first go
                    if at is None:
                        at = (place, start)
                    elif at != (place, start):
                        out.append((key, start, 1))
                    continue
                if at != (place, start):
                    for earlier in waiting:
                        automaton.add(earlier)
                    at, waiting = (place, start), []
                words = raw.split()
                found = automaton.statistics(words)
                out += [(key, start + k, 1) for k in range(size) if found[k + n - 1] >= n]
                waiting.append(words)
            if out:
                yield from _slices(list(zip(*out)), names, kinds)

    judged = checkpoint(runs.mapInArrow(stream, "key long, start int, size int"))
    release(spark)
    return gone.union(judged)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `key`, equal for rows of one id and text, and `place`, the order of documents."""
    return docs.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))


def deduplicate(docs: DataFrame, n: int = 20, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns`, n_words, n_removed and kept: the words that stay, joined by one blank (the text itself if all stay)."""
    return _finish(docs, n, columns, digest=False)


def _finish(docs: DataFrame, n: int, columns: tuple[str, ...], digest: bool) -> DataFrame:
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col("doc_id"), F.col("text").cast("string").alias("text"))
    own = keyed(own).drop("doc_id")
    spans = removed_windows(own.select("key", "place", "text"), n)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = own.drop("place").join(spans.hint("merge"), "key", "left").drop("key")
    fields = [StructField(c, docs.schema[c].dataType) for c in columns]
    out = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256" if digest else "kept", StringType())])

    def run(batches):
        for batch in pieces(batches):
            words, first, starts, ends, data = word_hashes(batch.column("text"), lower=False)
            count = np.diff(first)
            removed, kept = np.zeros(len(count), np.int64), []
            texts = None if digest else batch.column("text").to_pylist()
            raw = data.tobytes()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                a, b = int(first[i]), int(first[i + 1])
                if spans:
                    edge = np.zeros(count[i] + 1, np.int64)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["size"] + n - 1] -= 1
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + a
                    removed[i] = count[i] - len(stay)
                elif not digest:
                    kept.append(texts[i])
                    continue
                else:
                    stay = range(a, b)
                left = b" ".join([raw[starts[k] : ends[k]] for k in stay])
                kept.append(sha256(left).hexdigest() if digest else left.decode())
            rows = [batch.column(f"c{k}") for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=out.names)

    return joined.select(*[f"c{i}" for i in range(len(columns))], "text", "spans").mapInArrow(run, out)


def remove_known(docs: DataFrame, reference: list[str], n: int = 20, shard_words: int = 100_000) -> DataFrame:
    """doc_id, spans: maximal spans (start, length) in words of each document that occur in the reference, n words or more.

    The reference is a driver-side list; its automata are broadcast in shards of about `shard_words` words.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shards, held, size = [], [], 0
    for text in reference:
        words = (text or "").encode().split()
        if held and size + len(words) > shard_words:
            shards.append(held)
            held, size = [], 0
        held.append(words)
        size += len(words)
    shards.append(held)
    broadcasts = [spark.sparkContext.broadcast(s) for s in shards]

    def run(batches):
        automata = []
        for b in broadcasts:
            a = SuffixAutomaton()
            for words in b.value:
                a.add(words)
            automata.append(a)
        for batch in pieces(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                best = np.zeros(len(words), np.int64)
                for a in automata:
                    best = np.maximum(best, a.statistics(words))
                edge = np.zeros(len(words) + 1, np.int64)
                for e in np.flatnonzero(best >= n):
                    edge[e - best[e] + 1] += 1
                    edge[e + 1] -= 1
                inside = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
                turn = np.flatnonzero(np.diff(inside))
                out.append([{"start": int(s), "length": int(e - s)} for s, e in zip(turn[::2], turn[1::2])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], names=["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, spans array<struct<start:long,length:long>>")


ORACLE = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT *, min((doc_id, i)) OVER (PARTITION BY h) AS f FROM g) WHERE f < (doc_id, i)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
s AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.k) AS kept, count(*) AS n FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.k = a.k WHERE x.k IS NULL GROUP BY a.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(s.n, 0))::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)
"""


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return _finish(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20, ("doc_id",), digest=True)
