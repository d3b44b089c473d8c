"""Embedding near-duplicates against brute force, with hard rows."""

import numpy as np
import pytest

pytest.importorskip("strandwise.llm")
from strandwise.llm import embeddings  # noqa: E402


def brute(rows, cosine=0.9):
    good = [i for i, (k, e) in enumerate(rows) if k is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    best = {i: rows[i][0] for i in links}
    while True:
        new = {i: min([best[i], *(best[j] for j in links[i])]) if links[i] else best[i] for i in links}
        if new == best:
            return sorted(((rows[i][0] if rows[i][0] is not None else -1), len(links[i]), best[i] if best[i] is not None else -1) for i in links)
        best = new


@pytest.mark.parametrize("cell_rows,block_rows", [(1000, 1024), (40, 16)])
def test_near_duplicates(spark, cell_rows, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    x = centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 64)) * 1.2
    for i in range(200, 300):  # noisy copies around the threshold, in chains
        x[i] = x[i - rng.integers(1, 50)] + rng.normal(size=64) * rng.uniform(0.1, 0.9)
    x[300:330] = x[0] * 1.0
    x[330:340] = x[1] * 3.0
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [None] * 64), (902, [float("nan")] * 64), (903, [0.0] * 64), (None, x[0].tolist()), (904, [1.0, 0.1]), (905, [1.0, 0.0]), (906, []), (907, [float("inf")] * 64)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, copies int")
    got = embeddings.near_duplicates(df, cell_rows=cell_rows, block_rows=block_rows).collect()
    assert sorted(((-1 if r.vec_id is None else r.vec_id), r.n_links, (-1 if r.component_id is None else r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = embeddings.Cells(x, 4)
    codes, factor, turned = embeddings.encode(x, cells.rotation)
    found, half = embeddings.estimate(codes, factor, turned)
    off = ~np.eye(400, dtype=bool)
    error = (found - x @ x.T)[off]
    assert abs(error.mean()) < 2e-3
    assert (np.abs(found - x @ x.T) <= half[None, :] + 1e-5)[off].mean() > 0.999


@pytest.mark.parametrize("d", [64, 256])
def test_low_rank_vectors_lose_no_links(spark, d):
    """Neighbours that differ within a subspace of few dimensions, in more than one cell."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(d, 8)))[0].T
    low = rng.normal(size=(1200, 8))
    low = np.concatenate([low, low + rng.normal(size=low.shape) * 0.35 * np.linalg.norm(low, axis=1, keepdims=True) / np.sqrt(8)])
    x = (low @ basis).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, cell_rows=300, block_rows=256).collect()}
    assert got == dict(enumerate(near.sum(axis=1).tolist()))


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1e-200, 1e-201]), (3, [1e300, 1e299]), (4, [0.0, 1e300]), (5, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_vectors_are_not_copied_by_cell(spark, monkeypatch):
    """What is written to the shared folder follows the table, however many cells a vector asks."""
    import os

    from pyspark.sql import functions as F
    from strandwise.storage import Folder

    written, whole, drop = [], embeddings.checkpoint, Folder.drop

    def watch(df):
        out = whole(df)
        sizes = [F.coalesce(F.sum(F.length(c)), F.lit(0)) for c, kind in out.dtypes if kind == "binary"] + [F.coalesce(F.sum(8 * F.size(c)), F.lit(0)) for c, kind in out.dtypes if kind == "array<double>"]
        written.append(sum(out.agg(*sizes).first()) if sizes else 0)
        return out

    def watch_files(folder):
        path = folder.uri.removeprefix("file://")
        written.append(sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)))
        drop(folder)

    monkeypatch.setattr(embeddings, "checkpoint", watch)
    monkeypatch.setattr(Folder, "drop", watch_files)
    x = np.random.default_rng(4).normal(size=(1000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df, cell_rows=50).count() == 1000
    assert x.nbytes < sum(written) < 3 * x.nbytes
