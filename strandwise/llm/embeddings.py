"""Embedding near-duplicates by randomised-rotation binary codes.

Each unit vector is rotated at random and coded by its signs, with the inner product of the code and the rotated vector
stored with it as its correction factor f. <code, q> / f estimates a cosine without bias, within sqrt(1 - f^2) / f *
EPSILON / sqrt(d - 1) at the confidence of EPSILON standard deviations. Pairs whose upper bound is below the threshold
are rejected by their codes alone; all others are recomputed exactly in double precision.

Pairs come from cells (centroids fitted on a bounded sample). A vector is indexed in its nearest cell and asks those
cells that can be nearest to a vector within the threshold's angle: moving by that angle in a direction u, the lead
s_home - s_cell of its own cell must fall by the projection of u on the difference of the centroids, which is at most
that difference's length (Cauchy-Schwarz), whatever the vectors are. Both vectors of a pair must ask the other's cell.
Cells are blocks of fixed size, files in the shared folder that every vector is in once: a task reads those that its
block asks, so nothing is copied by cell. A crowded cell is many small tiles; equal vectors are one representative with a
count. No pairs leave a tile: it returns a count and a group for each vector.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those without an id, link with
nothing and are kept; vectors of different lengths never link; repeated rows and repeated ids are vectors of their own;
components may be as small or large as doubles are (a vector is scaled by a power of two, exactly); an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Folder, checkpoint, components, release

EPSILON = 5.0


class Cells:
    """Rotation and centroids for vectors of one length, fitted on a sample."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 7, rounds: int = 8):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        x = unit(sample)
        c = x[rng.permutation(len(x))[: max(1, min(cells, len(x)))]]
        for _ in range(rounds if len(c) > 1 else 0):
            home = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, home, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        self.centroids = c
        self.gram = c @ c.T

    def place(self, x: np.ndarray) -> np.ndarray:
        """Home cell of each unit vector."""
        return (x @ self.centroids.T).argmax(axis=1)

    def asks(self, x: np.ndarray, home: int, cells: np.ndarray, cosine: float) -> np.ndarray:
        """Whether each unit vector of a home cell asks each of the cells."""
        lead = (x @ self.centroids[home])[:, None] - x @ self.centroids[cells].T
        # squared length of centroid - home centroid, without its part along x
        apart = np.maximum(0, 2 - 2 * self.gram[home, cells] - lead**2)
        slope = math.sqrt(1 - cosine**2) / cosine if cosine > 0 else math.inf
        # the allowance covers the rounding of apart, whose root is taken
        return lead <= slope * np.sqrt(apart) + 1e-7


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors by powers of two, so that no square over- or underflows where it counts; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def encode(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as bits, correction factors, rotated vectors) of unit vectors."""
    turned = x @ rotation
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1]), turned


def estimate(codes: np.ndarray, factor: np.ndarray, turned: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner product of each turned vector with each coded one, half width of its confidence interval)."""
    d = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    found = turned.astype(np.float32) @ signs.T / (math.sqrt(d) * factor).astype(np.float32)
    return found, np.sqrt(np.maximum(0, 1 - factor**2)) / factor * epsilon / math.sqrt(max(1, d - 1)) + 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_pairs(a: np.ndarray, b: np.ndarray, codes: np.ndarray, factor: np.ndarray, rotation: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) with at least that cosine, b having these codes and factors; i < j where a and b are the same."""
    found, half = estimate(codes, factor, unit(a) @ rotation)
    maybe = found + half[None, :].astype(np.float32) >= cosine
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    sure = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        dot = np.einsum("ij,ij->i", a[p], b[q])
        sure[at : at + (1 << 16)] = dot / (np.linalg.norm(a[p], axis=1) * np.linalg.norm(b[q], axis=1)) >= cosine
    return i[sure], j[sure]


def _pack(v: np.ndarray) -> bytes:
    """Bytes of a vector, or of several, as singles if all is made of such."""
    small = v.astype(np.float32)
    return small.tobytes() if (small == v).all() else v.tobytes()


def _unpack(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32).astype(np.float64) if len(raw) == 4 * d else np.frombuffer(raw)


class Block:
    """Classes of one cell: a file."""

    def __init__(self, ids, copies, x, codes, factor):
        self.ids, self.copies, self.x, self.codes, self.factor = ids, copies, x, codes, factor

    def to_bytes(self) -> bytes:
        return b"".join([len(self.ids).to_bytes(8, "little"), self.ids.tobytes(), self.copies.tobytes(), self.factor.tobytes(), self.codes.tobytes(), _pack(self.x)])

    def part(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.copies[rows], self.x[rows], self.codes[rows], self.factor[rows])

    @classmethod
    def from_bytes(cls, raw: bytes, d: int) -> Block:
        n = int.from_bytes(raw[:8], "little")
        code = 8 + 24 * n
        end = code + n * -(-d // 8)
        ids, copies = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
        return cls(ids, copies, _unpack(raw[end:], n * d).reshape(n, d), np.frombuffer(raw, np.uint8, end - code, code).reshape(n, -1), np.frombuffer(raw, np.float64, n, 8 + 16 * n))


def _write_blocks(folder: Folder, rows: int):
    """Rows sorted by cell, written as blocks; gives (dims, cell, block)."""

    def run(batches):
        cell, held, number = None, [], 0

        def flush():
            ids, copies, x, code, factor = zip(*held)
            block = Block(np.array(ids, np.int64), np.array(copies, np.int64), np.stack([_unpack(v, cell[0]) for v in x]), np.frombuffer(b"".join(code), np.uint8), np.array(factor))
            folder.write("-".join(map(str, (*cell, number))), block.to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (*cell, number)], names=["dims", "cell", "block"])

        for b in batches:
            for d, c, *row in zip(*(b.column(k).to_pylist() for k in ("dims", "cell", "class", "copies", "x", "code", "factor"))):
                if held and ((d, c) != cell or len(held) == rows):
                    yield flush()
                    number, held = number + 1 if (d, c) == cell else 0, []
                cell = d, c
                held.append(row)
        if held:
            yield flush()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, cell_rows: int = 1000, most_cells: int = 4096, sample_rows: int = 20_000, block_rows: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    good = F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("e", lambda v: v != 0)
    vectors = vectors.withColumn("good", F.coalesce(good, F.lit(False)))

    def pack(batches):
        for b in batches:
            lengths = pa.compute.list_value_length(b.column("e")).to_numpy()
            for d in np.unique(lengths):
                part = b.filter(pa.array(lengths == d))
                x = scaled(part.column("e").flatten().to_numpy().reshape(-1, d))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("vec_id", "class", "check")), pa.array(np.full(len(x), d), pa.int32()), pa.array([_pack(v) for v in x], pa.binary())], names=["vec_id", "class", "check", "dims", "x"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    # classes are equal vectors, named by a hash under which no two classes are alike, as another hash tells; vectors travel once, as singles if they can
    for seed in range(8):
        hashed = vectors.where("good").select("vec_id", F.xxhash64(F.lit(seed), "e").alias("class"), F.xxhash64(F.lit(seed + 100), "e").alias("check"), "e")
        packed = hashed.mapInArrow(pack, f"vec_id {id_type}, class long, check long, dims int, x binary")
        classes = checkpoint(packed.groupBy("class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("dims").alias("dims"), F.first("x").alias("x"), (F.min("check") < F.max("check")).alias("alike")))
        release(spark)
        if not classes.where("alike").count():
            break
    else:
        raise RuntimeError("hashes of vectors collide")
    named = vectors.select("vec_id", F.when(F.col("good"), F.xxhash64(F.lit(seed), "e")).alias("class"))
    sizes = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().collect()}
    total = sum(sizes.values())
    if not total:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = min(1.0, sample_rows / total)
    drawn = classes.where(F.pmod(F.xxhash64("class"), F.lit(1_000_003)) / 1_000_003.0 < share) if share < 1 else classes
    sample: dict[int, list] = {}
    for r in sorted(drawn.select("class", "dims", "x").limit(2 * sample_rows).collect()):
        sample.setdefault(r["dims"], []).append(_unpack(r["x"], r["dims"]))
    models = {d: Cells(np.array(sample.get(d) or np.eye(d)[:1]), min(most_cells, math.ceil(n / cell_rows))) for d, n in sizes.items()}
    shared = spark.sparkContext.broadcast(models)

    def place(batches):
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x, model = np.stack([_unpack(v, d) for v in part.column("x").to_pylist()]), shared.value[int(d)]
                codes, factor, _ = encode(unit(x), model.rotation)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dims"), pa.array(model.place(unit(x)), pa.int32()), *(part.column(k) for k in ("class", "copies", "x")), pa.array([v.tobytes() for v in codes], pa.binary()), pa.array(factor)],
                    names=["dims", "cell", "class", "copies", "x", "code", "factor"],
                )

    folder = Folder.new(spark, "embeddings")
    try:
        placed = classes.select("class", "copies", "dims", "x").mapInArrow(place, "dims int, cell int, class long, copies long, x binary, code binary, factor double")
        blocks = checkpoint(placed.repartition("dims", "cell").sortWithinPartitions("dims", "cell", "class").mapInArrow(_write_blocks(folder, block_rows), "dims int, cell int, block int"))
        release(spark)
        # by length of vectors, the number of blocks of each cell
        held = {d: np.zeros(len(m.centroids), np.int64) for d, m in models.items()}
        for r in blocks.groupBy("dims", "cell").count().collect():
            held[r["dims"]][r["cell"]] = r["count"]
        many = spark.sparkContext.broadcast(held)

        def link(batches):
            for batch in batches:
                for d, home, own in zip(*(batch.column(c).to_pylist() for c in ("dims", "cell", "block"))):
                    model, count = shared.value[d], many.value[d]
                    read = lambda cell, block: Block.from_bytes(folder.read(f"{d}-{cell}-{block}"), d)  # noqa: B023, E731
                    b = read(home, own)
                    later = np.flatnonzero(count)
                    later = later[later > home]
                    ub = unit(b.x)
                    asks = model.asks(ub, home, later, cosine)
                    # a pair meets once: with blocks of the own cell up to this one, and of later cells that it asks and that ask its cell
                    for number in range(own + 1):
                        a = b if number == own else read(home, number)
                        yield from found(a, b, d, number == own)
                    for k in np.flatnonzero(asks.any(axis=0)):
                        mine = b.part(asks[:, k])
                        for number in range(count[later[k]]):
                            a = read(int(later[k]), number)
                            yield from found(a.part(model.asks(unit(a.x), later[k], np.array([home]), cosine)[:, 0]), mine, d, False)

        def found(a, b, d, same):
            if not (len(a.ids) and len(b.ids)):
                return
            i, j = tile_pairs(a.x, b.x, b.codes, b.factor, shared.value[d].rotation, cosine, same)
            if not len(i):
                return
            ids, copies = (a.ids, a.copies) if same else (np.concatenate([a.ids, b.ids]), np.concatenate([a.copies, b.copies]))
            j = j + (0 if same else len(a.ids))
            links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            root = _groups(i, j, len(ids))
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(ids[root[at]])], names=["class", "links", "root"])

        # a block is a row, and a task few of them
        tasks = max(1, min(sum(int(h.sum()) for h in held.values()), 100_000))
        linked = checkpoint(blocks.repartition(tasks).mapInArrow(link, "class long, links long, root long"))
    finally:
        folder.drop()
    release(spark)
    groups = components(linked.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "class")
    of = classes.select("class", "copies", "least").join(linked.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    of = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component_id")
    out = named.select("vec_id", "class").join(of, "class", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))


def _groups(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """A member of each row's group, for pairs of rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
c AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT l.a, c.r FROM c JOIN l ON l.b = c.id),
m AS (SELECT id, min(r) AS component_id FROM c GROUP BY id),
d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN d ON d.a = vec_id
"""


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
