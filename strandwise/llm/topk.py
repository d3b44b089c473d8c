"""Exact top-k inner products over an impact-ordered index, score at a time.

Components become integers floor(scale * x), kept as doubles. The index cuts each vector's postings (one a dimension) into segments by
the binary logarithm of the impact, so a segment holds all postings of a block whose impact lies in [2^j, 2^(j+1)).
Segments are processed by descending impact for a block of queries at once; after each, a candidate's score is known
within +-|w| * |rest|, w the query's part in the dimensions and rest the norm of the candidate's postings that are
still out (Cauchy-Schwarz). A query stops when this proves that few candidates can be in its top k; those are rescored
with all their components.

Queries go against all rows in blocks: every pair of a query block and an index block is one row of a join, with k
rows a query as its result. Blocks have a fixed number of rows, so memory doesn't grow with the data.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id take no part;
vectors are compared with those of as many dimensions; ties go to the smaller id; repeated rows with an id other than
the query's are separate candidates, and repeated query ids are queries once each per different vector; scores are exact
for components of any size, and one that doesn't fit a long is an error; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint


def segments(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By descending impact: (postings of the segment as a matrix with zeros elsewhere, norm of what is still out)."""
    exponent = np.where(x == 0, -1, np.frexp(np.abs(x).astype(np.float64))[1])
    out, rest = [], x.astype(np.float64).copy()
    for j in sorted(set(exponent[exponent >= 0].tolist()), reverse=True):
        here = np.where(exponent == j, x, 0).astype(np.float64)
        rest = rest - here
        out.append((here, np.sqrt((rest * rest).sum(axis=1))))
    return out


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, few: int = 64) -> list[tuple[int, int, int]]:
    """(row of q, id, score) of each query's k best in the block, ties to the smaller id, the query's own id left out."""
    n = len(ids)
    top = float(max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)))
    if top * top * x.shape[1] >= 2**52:  # beyond what doubles add up exactly
        return _search_large(ids, x, query_ids, q, k)
    acc = np.zeros((len(q), n))
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    own = query_ids[:, None] == ids[None, :]
    acc[own] = -np.inf
    live = np.arange(len(q))
    members: dict[int, np.ndarray] = {}
    x, q = np.asarray(x, np.float64), np.asarray(q, np.float64)
    for here, rest in segments(x):
        acc[live] += q[live].astype(np.float64) @ here.T
        bound = norm[live, None] * rest[None, :] + 1e-6
        low, high = acc[live] - bound, acc[live] + bound
        kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(live), -np.inf)
        possible = (high >= kth[:, None]) & (acc[live] > -np.inf)
        proven = possible.sum(axis=1) <= max(few, k)
        for i in np.flatnonzero(proven):
            members[int(live[i])] = np.flatnonzero(possible[i])
        live = live[~proven]
        if not len(live):
            break
    for i in live:  # all postings are in: whatever still ties
        kth = np.partition(acc[i], n - k)[n - k] if n > k else -np.inf
        members[int(i)] = np.flatnonzero((acc[i] >= kth) & (acc[i] > -np.inf))
    out = []
    whole = x.astype(np.int64)
    for i, at in members.items():
        score = whole[at] @ q[i].astype(np.int64)
        best = np.lexsort((ids[at], -score))[:k]
        out += [(i, int(ids[at[b]]), int(score[b])) for b in best]
    return out


def _search_large(ids, x, query_ids, q, k):
    whole, out = [[int(v) for v in row] for row in x], []
    for i, row in enumerate(q):
        row = [int(v) for v in row]
        scores = sorted((-sum(map(int.__mul__, row, c)), int(v)) for v, c in zip(ids, whole) if v != query_ids[i])[:k]
        if any(abs(s) >= 2**63 for s, _ in scores):
            raise OverflowError(f"a score of query {query_ids[i]} doesn't fit a long")
        out += [(i, v, -s) for s, v in scores]
    return out


def _block_schema(prefix: str) -> str:
    return f"{prefix}_block long, dims int, {prefix}_ids binary, {prefix}_x binary"


def _pack(prefix: str, rows: int):
    """Rows (block, id, v) sorted by block, to one row a block of at most `rows` vectors."""

    def run(batches):
        block, ids, xs = None, [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([len(xs[0])], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(xs, np.float64).tobytes()], pa.binary())],
                names=[f"{prefix}_block", "dims", f"{prefix}_ids", f"{prefix}_x"],
            )

        for b in batches:
            for k, i, v in zip(b.column("block").to_pylist(), b.column("id").to_pylist(), b.column("v").to_pylist()):
                if ids and (k != block or len(ids) == rows or len(v) != len(xs[0])):
                    yield flush()
                    ids, xs = [], []
                block = k
                ids.append(i)
                xs.append(v)
        if ids:
            yield flush()

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256, rows: int = 4096, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score; queries and candidates are (vec_id, embedding)."""

    def integers(df: DataFrame) -> DataFrame:
        x = F.transform("embedding", lambda e: F.lit(float(scale)) * e.cast("double"))
        good = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
        return df.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(good).select(F.col("vec_id").cast("long").alias("id"), x.alias("v"))

    def blocks(df: DataFrame, prefix: str, per: int) -> DataFrame:
        many = max(1, math.ceil(df.count() / per))
        tagged = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many)) * 65536 + F.size("v"))
        # a block's rows meet in one partition, are sorted by block and packed as they stream by
        return tagged.repartition("block").sortWithinPartitions("block", "id").mapInArrow(_pack(prefix, 2 * per), _block_schema(prefix))

    index = checkpoint(blocks(integers(candidates), "c", rows))
    wanted = checkpoint(blocks(integers(queries).distinct(), "q", query_rows))
    by_dims = index.select("dims", "c_block", F.length("c_ids").alias("c_bytes")).distinct()
    pairs = wanted.join(by_dims, "dims").select("dims", "c_block", "q_ids", "q_x").join(index, ["dims", "c_block"])

    def run(batches):
        for b in batches:
            for dims, ci, cx, qi, qx in zip(*(b.column(c).to_pylist() for c in ("dims", "c_ids", "c_x", "q_ids", "q_x"))):
                shape = lambda raw, d=dims: np.floor(np.frombuffer(raw).reshape(-1, d))
                ids, wanted = np.frombuffer(qi, np.int64), shape(qx)
                found = search_block(np.frombuffer(ci, np.int64), shape(cx), ids, wanted, k)
                q, v, s = zip(*found) if found else ((), (), ())
                # a query is its id and its vector
                vector = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(q)], pa.int64()), pa.array([vector[i] for i in q], pa.binary()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vector", "vec_id", "score"])

    found = pairs.select("dims", "c_ids", "c_x", "q_ids", "q_x").mapInArrow(run, "query_id long, vector binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)
