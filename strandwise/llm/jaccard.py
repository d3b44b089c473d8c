"""Similarity join of documents by the Jaccard index of their word n-grams, as a T-occurrence search.

1. Each document becomes its set of n-gram hashes; documents with equal sets form a class, and only classes go on.
2. Sets of like size (of one band or two adjoining ones) are cut into more parts, by ranges of hashes, than linked sets
   can differ in n-grams: two that reach the threshold agree in a whole part (pigeonhole). So the connected components of
   "has the same part and band" hold every link. A part has some 8 n-grams at a threshold of 0.9, so texts that share
   single n-grams by chance, of which a large table is full, don't meet; no n-gram is counted.
3. A component is one tile, or, if large, tiles of pairs of blocks with like set sizes: a block holds about
   `block_grams` n-grams, whatever the component's size. Nothing is ever expanded into pairs by a join.
4. In a tile sets are compared as bits of the n-grams that several of them have, or, where that takes long, every set
   searches the inverted lists: DivideSkip merges its short lists with a heap, keeps ids that occur often enough, and
   probes the long ones by binary search.

Links are then counted by class, and components of links found over a spanning forest of each tile.

Defined results: a null or empty text has an empty set, no links and is its own component; fewer than n words make one
n-gram; repeated rows are documents that link with each other; a null doc_id takes part, but never names a component
unless all its members lack one; an empty table gives no rows; extra columns are ignored, or pass as they are, whatever
their names.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import U64, checkpoint, components, gram_hashes, mix, pieces, release, row_key, word_hashes

FILTER_BITS = 26
#: bits of the filter that is joined to rows: 64 a row of it
ROW_BITS = 24
#: words of bits compared in a tile; one that takes more is searched by DivideSkip
MOST_WORDS = 1 << 28
_FILTER_PARTS = 64


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct n-grams of each text in ascending order, bounds of each text's)."""
    words, first, *_ = word_hashes(column, lower=True)
    docs, count = len(first) - 1, np.diff(first)
    grams = gram_hashes(words, n)
    doc = np.repeat(np.arange(docs), count)
    place = np.arange(len(words)) - np.repeat(first[:-1], count)
    whole = place >= n - 1
    g, d = [grams[whole]], [doc[whole]]
    for m in range(1, n):  # texts of fewer words
        short = np.flatnonzero(count == m)
        if len(short):
            g.append(gram_hashes(words, m)[first[short] + m - 1])
            d.append(short)
    g, d = np.concatenate(g), np.concatenate(d)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[keep], d[keep]
    return g, np.searchsorted(d, np.arange(docs + 1))


def class_keys(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    sums = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(mix(g ^ U64(0xABCDEF123)), out=sums[1:])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def parts(band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts that sets of that band or the one below are cut into, how many more these are than the n-grams in which two linked ones differ)."""
    width = _width(percent)
    low, high = np.exp((band - 1) * width), np.floor(np.exp((band + 1) * width)) + 1
    differ = (2 * high * (100 - percent) // (100 + percent)).astype(np.int64)
    # spare parts are as many as are empty in most sets
    many = differ + 1
    for _ in range(20):
        many = np.minimum(differ + 2 + np.ceil(2 * many * np.exp(-low / many)).astype(np.int64), 2 * differ + 4)
    return np.where(differ > 0, many, 0), many - differ


def part_keys(g: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set of each): linked sets that differ have a key in common, as they agree in a part that isn't empty or both have many empty ones."""
    size = np.diff(bounds)
    band = np.floor(np.log(np.maximum(size, 1)) / _width(percent)).astype(np.int64)
    sums = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(mix(g ^ U64(0x51ED270B7A4F3C19)), out=sums[1:])
    keys, owners = [], []
    for own in (band, band + 1):
        many, spare = parts(own, percent)
        many[size == 0] = 0
        doc = np.repeat(np.arange(len(size)), np.where(many > 0, size, 0))
        at = np.flatnonzero(np.repeat(many > 0, size))
        if not len(at):
            continue
        # parts are ranges of hashes, so those of a sorted set are runs
        part = (g[at] >> U64(32)) * many[doc].astype(np.uint64) >> U64(32)
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]))
        total = sums[np.append(at[head[1:] - 1], at[-1]) + 1] - sums[at[head]]
        doc, part = doc[head], part[head]
        empty = many - np.bincount(doc, minlength=len(size))
        bare = np.flatnonzero((many > 0) & (empty >= spare))
        if len(bare):
            start = np.zeros(len(size) + 1, np.int64)
            start[bare + 1] = many[bare]
            start = np.cumsum(start)
            lacks = np.ones(start[-1], bool)
            mine = np.isin(doc, bare)
            lacks[start[doc[mine]] + part[mine].astype(np.int64)] = False
            lacks = np.flatnonzero(lacks)
            of = np.searchsorted(start, lacks, "right") - 1
            doc, part, total = np.concatenate([doc, of]), np.concatenate([part, (lacks - start[of]).astype(np.uint64)]), np.concatenate([total, np.zeros(len(of), np.uint64)])
        keys.append(mix(total + mix(part + (own[doc].astype(np.uint64) << U64(40)))))
        owners.append(doc)
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _width(percent: int) -> float:
    """Logarithm of the ratio of set sizes that a band spans: a little over that of linked sets."""
    return float(np.log(100 / percent) * 1.001) if percent < 100 else 1.0


def _class_filter(classes: DataFrame) -> bytes:
    """A bit for the first FILTER_BITS bits of each class: a fixed size, for any input."""

    def run(batches):
        bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for b in batches:
            slot = (b.column("class").to_numpy().view(np.uint64) >> U64(64 - FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        for part, x in enumerate(np.split(bits, _FILTER_PARTS)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "bits"])

    def add(batches):
        part, total = None, None
        for b in batches:
            for p, raw in zip(b.column("part").to_pylist(), b.column("bits").to_pylist()):
                if p != part:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "bits"])
                    part, total = p, np.zeros(len(raw), np.uint8)
                total |= np.frombuffer(raw, np.uint8)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "bits"])

    schema = "part int, bits binary"
    out = np.zeros((_FILTER_PARTS, (1 << FILTER_BITS - 3) // _FILTER_PARTS), np.uint8)
    for r in classes.select("class").mapInArrow(run, schema).repartition("part").sortWithinPartitions("part").mapInArrow(add, schema).collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


class InvertedLists:
    """Lists of set numbers by n-gram, for sets given in order of size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        gram = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(gram, kind="stable")
        self.owner, gram = owner[order], gram[order]
        self.gram, self.start = np.unique(gram, return_index=True)
        self.end = np.append(self.start[1:], len(gram))

    def bits(self, most_words: int) -> np.ndarray | None:
        """The n-grams that several sets have, as bits by set; None if comparing all pairs of sets takes more words than that."""
        shared = np.flatnonzero(self.end - self.start > 1)
        words = max(1, -(-len(shared) // 64))
        if len(self.sets) ** 2 // 2 * words > most_words:
            return None
        out = np.zeros((len(self.sets), words), np.uint64)
        count = (self.end - self.start)[shared]
        at = np.repeat(self.start[shared], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        number = np.repeat(np.arange(len(shared)), count)
        np.bitwise_or.at(out, (self.owner[at], number >> 6), U64(1) << (number & 63).astype(np.uint64))
        return out

    def search(self, query: np.ndarray, t: int, below: int) -> list[tuple[int, int]]:
        """(set, overlap) of the sets numbered under `below` that share at least t n-grams with the query, by DivideSkip."""
        at = np.searchsorted(self.gram, query)
        at[at == len(self.gram)] = 0
        hit = self.gram[at] == query if len(self.gram) else np.zeros(len(query), bool)
        at, grams = at[hit], query[hit]
        if len(at) < t:
            return []
        length = self.end[at] - self.start[at]
        order = np.argsort(length, kind="stable")
        long_lists = self._long(t, int(length.max()))
        short = at[order[: len(order) - long_lists]]
        probes = np.sort(grams[order[len(order) - long_lists :]])
        lists = []
        for k in short:
            x = self.owner[self.start[k] : self.end[k]]
            x = x[: np.searchsorted(x, below)]
            if len(x):
                lists.append(x.tolist())
        out = []
        for number, same in itertools.groupby(heapq.merge(*lists)):
            count = sum(1 for _ in same)
            if count >= t - long_lists:
                if long_lists:
                    other = self.sets[number]
                    p = np.searchsorted(other, probes)
                    p[p == len(other)] = 0
                    count += int((other[p] == probes).sum())
                if count >= t:
                    out.append((number, count))
        return out

    @staticmethod
    def _long(t: int, longest: int, mu: float = 0.01) -> int:
        """How many of the longest lists are probed; at most t - 1, so that a member shows in a short one."""
        return max(0, min(t - 1, int(t / (mu * np.log2(longest + 1) + 1))))


def tile_links(ids: np.ndarray, sizes: np.ndarray, code: np.ndarray, sets: list[np.ndarray], percent: int, across: bool):
    """(id, other documents linked, root of its group in the tile) of each linked class."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sets = [sets[i] for i in order]
    ids, sizes, code = ids[order], sizes[order], code[order]
    lists, parent, links = InvertedLists(sets), list(range(len(ids))), {}
    length = np.array([len(s) for s in sets])
    bits = lists.bits(MOST_WORDS)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        if not len(s):
            continue
        # the larger set of a pair asks: overlap >= t * union >= t * its own size
        least = -(-percent * len(s) // 100)
        if bits is None:
            found = lists.search(s, least, i)
        else:
            a = int(np.searchsorted(length, least))
            overlaps = np.bitwise_count(bits[a:i] & bits[i]).sum(axis=1, dtype=np.int64)
            at = np.flatnonzero(overlaps >= least)
            found = zip((at + a).tolist(), overlaps[at].tolist())
        for j, overlap in found:
            if (not across or code[i] != code[j]) and 100 * overlap >= percent * (len(s) + len(sets[j]) - overlap):
                links[i] = links.get(i, 0) + int(sizes[j])
                links[j] = links.get(j, 0) + int(sizes[i])
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(int(ids[i]), n, int(ids[root(i)])) for i, n in links.items()]


def similar(docs: DataFrame, n: int = 5, percent: int = 90, block_grams: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id."""
    return _grouped(docs.select("doc_id", "text", F.lit("").alias("key")), n, percent, block_grams).select("doc_id", "n_shingles", "n_similar", "component_id")


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, that of the smallest id; rows that are equal in all columns count once."""
    hashes = row_key(docs.columns)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.concat(F.hex(hashes["a"]), F.lit("/"), F.hex(hashes["b"])).alias("key"))
    groups = checkpoint(_grouped(keyed, **options).select("key", "doc_id", "group"))
    release(docs.sparkSession)
    of = groups.groupBy("group").agg(F.count("*").alias("rows"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("kept"))
    # rows alone in their group stay where they are: a filter of fixed size tells most of them, the others are shuffled
    slot = F.shiftrightunsigned(F.xxhash64("key"), 64 - ROW_BITS)
    place = {"word": F.shiftright(slot, 6), "bit": slot.bitwiseAND(63).cast("int")}
    several = groups.join(of.where("rows > 1").select("group").hint("merge"), "group", "left_semi").select(*[c.alias(k) for k, c in place.items()])
    bits = several.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    told = keyed.select("row", "key", *[c.alias(k) for k, c in place.items()]).join(F.broadcast(bits), "word", "left")
    maybe = F.coalesce(F.expr("bit_get(bits, bit) = 1"), F.lit(False))
    shuffled = told.where(maybe).select("row", "key").dropDuplicates(["key"]).join(of.select(F.col("kept").alias("key")).hint("merge"), "key", "left_semi")
    return told.where(~maybe).select("row.*").union(shuffled.select("row.*"))


def _grouped(docs: DataFrame, n: int = 5, percent: int = 90, block_grams: int = 500_000) -> DataFrame:
    """doc_id, key, n_shingles, n_similar, component_id, group: the key is carried along, and stands for the group of an empty set."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "key")
    def name(batches):
        for batch in pieces(batches):
            g, bounds = shingle_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.diff(bounds), pa.int64()), pa.array(class_keys(g, bounds), pa.int64())], names=["doc_id", "key", "n_shingles", "class"])

    named = checkpoint(docs.mapInArrow(name, f"doc_id {id_type}, key string, n_shingles long, class long"))
    classes = checkpoint(named.where("n_shingles > 0").groupBy("class", "n_shingles").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")))

    width = _width(percent)

    def cut(batches):
        for batch in pieces(batches):
            g, bounds = shingle_sets(batch.column("text"), n)
            keys, doc = part_keys(g, bounds, percent)
            keys, own = keys.view(np.int64), class_keys(g, bounds)[doc]
            by = np.lexsort((own, keys))
            keys, own = keys[by], own[by]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
            keys, own = keys[new], own[new]
            for a in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 200_000]), pa.array(own[a : a + 200_000])], names=["key", "class"])

    def chain(batches):
        # rows come by key and class: classes with a key in common are linked one to the next
        last = None
        for b in batches:
            key, own = b.column("key").to_numpy(), b.column("class").to_numpy()
            if last is not None:
                key, own = np.insert(key, 0, last[0]), np.insert(own, 0, last[1])
            last = key[-1], own[-1]
            at = np.flatnonzero((key[1:] == key[:-1]) & (own[1:] != own[:-1]))
            pair = np.unique(np.stack([own[at], own[at + 1]]), axis=1)
            if pair.size:
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    first = docs.select("text").mapInArrow(cut, "key long, class long")
    edges = first.repartition("key").sortWithinPartitions("key", "class").mapInArrow(chain, "a long, b long")
    near = components(edges)
    release(spark)

    # blocks of a component: all of it, or by band of set size; sizes of linked sets differ by one band at most
    member = classes.join(near, classes["class"] == near["id"]).select("class", "n_shingles", "copies", "component")
    whole = member.groupBy("component").agg(F.sum("n_shingles").alias("grams"))
    member = member.join(whole, "component").withColumn("large", F.col("grams") > block_grams)
    member = member.withColumn("band", F.when(F.col("large"), F.floor(F.log("n_shingles") / width)).otherwise(F.lit(0)).cast("long"))
    bands = member.groupBy("component", "band").agg(F.ceil(F.sum("n_shingles") / block_grams).cast("long").alias("subs"))
    order = Window.partitionBy("component").orderBy("band")
    beside = lambda f: F.when(f("band").over(order) == F.col("band") + (1 if f is F.lead else -1), f("subs").over(order)).otherwise(F.lit(0))
    bands = bands.select("component", "band", "subs", beside(F.lead).alias("above"), beside(F.lag).alias("under"))
    step = 1 << 20
    codes = lambda band, many: F.when(many > 0, F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda s: band * step + s)).otherwise(F.array().cast("array<long>"))
    band = F.col("band")
    member = member.join(bands, ["component", "band"]).withColumn("code", band * step + F.when(F.col("large"), F.pmod(F.xxhash64("class"), F.col("subs"))).otherwise(F.lit(0)))
    others = F.when(F.col("large"), F.concat(codes(band, F.col("subs")), codes(band + 1, F.col("above")), codes(band - 1, F.col("under")))).otherwise(F.array(F.lit(0).cast("long")))
    tiles = member.select("class", "copies", "component", "code", F.explode(others).alias("other")).select("class", "copies", "component", "code", F.least("code", "other").alias("lo"), F.greatest("code", "other").alias("hi"))
    tiles = checkpoint(tiles)

    # a filter of fixed size spares most sets the way; the join below decides
    some = spark.sparkContext.broadcast(_class_filter(tiles))

    def emit(batches):
        bits = np.frombuffer(some.value, np.uint8)
        for batch in pieces(batches):
            g, bounds = shingle_sets(batch.column("text"), n)
            key = class_keys(g, bounds)
            _, once = np.unique(key, return_index=True)
            slot = (key[once].view(np.uint64) >> U64(64 - FILTER_BITS)).astype(np.int64)
            once = once[(np.diff(bounds)[once] > 0) & (bits[slot >> 3] >> (slot & 7) & 1 > 0)]
            if not len(once):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(key[once], pa.int64()), pa.array([g[bounds[i] : bounds[i + 1]].tobytes() for i in once], pa.binary())], names=["class", "grams"])

    # one copy of each class that shares anything; the sets meet their tiles by class
    sets = docs.select("text").mapInArrow(emit, "class long, grams binary").join(tiles.select("class").distinct().hint("merge"), "class", "left_semi")
    placed = sets.groupBy("class").agg(F.first("grams").alias("grams")).join(tiles.hint("merge"), "class")

    def link(table: pa.Table) -> pa.Table:
        ids, first_of = np.unique(table.column("class").to_numpy(), return_index=True)
        table = table.take(pa.array(first_of))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        found = tile_links(ids, table.column("copies").to_numpy(), table.column("code").to_numpy(), sets, percent, table.column("lo")[0] != table.column("hi")[0])
        a, m, b = zip(*found) if found else ((), (), ())
        return pa.table({"class": pa.array(a, pa.int64()), "links": pa.array(m, pa.int64()), "root": pa.array(b, pa.int64())})

    linked = checkpoint(placed.groupBy("component", "lo", "hi").applyInArrow(link, "class long, links long, root long"))
    release(spark)
    groups = components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    total = linked.groupBy("class").agg(F.sum("links").alias("links"))
    of = classes.join(total, "class", "left").join(groups.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(names, "component").select("class", F.col("n_shingles").alias("_n"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id", "component")
    out = named.join(of, (named["class"] == of["class"]) & (named["n_shingles"] == of["_n"]), "left")
    return out.select("doc_id", "key", F.coalesce(F.col("component").cast("string"), "key").alias("group"), "n_shingles", F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
c AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT l.a, c.r FROM c JOIN l ON l.b = c.id),
m AS (SELECT id, min(r) AS component_id FROM c GROUP BY id),
d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(d.k, 0)::BIGINT AS n_similar, component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN d ON d.a = doc_id JOIN m ON m.id = doc_id
"""


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
