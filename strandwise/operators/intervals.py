"""Interval algebra over DataFrames with chr, start and end (1-based, closed).

Overlaps are found by an equi-join on bins. Bins come in levels of width, and an interval belongs to the least level that
is as wide as it is long, so it touches two bins at most; a pair meets in the coarser level of its two. Each side lists
its bins in its own level and in those coarser levels that the other side has, and a pair is kept only in the later of
the two bins in which the sides begin, so no pair comes twice and nothing needs a distinct. Merging is by running maxima
and islands. AQE splits skewed (chr, level, bin) keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import checkpoint

#: binary logarithms of the widths of bins
LEVELS = (8, 12, 16, 20, 24, 30, 40)


def _level(start: str, end: str) -> Column:
    """The least level that is as wide as the interval is long."""
    length, out = F.col(end) - F.col(start) + 1, F.lit(LEVELS[-1])
    for bits in LEVELS[-2::-1]:
        out = F.when(length <= 1 << bits, F.lit(bits)).otherwise(out)
    return out


def levels_of(df: DataFrame) -> list[int]:
    """The levels of a table's intervals: one pass over its starts and ends."""
    return sorted(r[0] for r in df.where("start <= end").select(_level("start", "end").alias("l")).distinct().collect())


def _bins(df: DataFrame, start: str, end: str, others: list[int], names: tuple[str, str]) -> DataFrame:
    d = df.withColumn("_own" + names[0], _level(start, end))
    levels = F.array_distinct(F.transform(F.array(*[F.lit(x) for x in others]), lambda x: F.greatest(x, F.col("_own" + names[0]))))
    d = d.withColumn(names[0], F.explode(levels))
    shift = lambda x: F.expr(f"shiftright(CAST({x} AS BIGINT), {names[0]})")
    first, last = shift(f"`{start}`"), shift(f"`{end}`")
    return d.withColumn(names[1], F.explode(F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", suffix: str = "_2", levels: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Pairs of overlapping intervals; columns of the right side get a suffix. how: inner, left_semi or left_anti.

    levels: those of the left and right side, where they are known (default: looked up). Semi and anti joins key the left
    side by its place.
    """
    if how == "inner":
        mine, others = levels or (levels_of(left), levels_of(right))
        right = right.select(*[F.col(c).alias(c + suffix) for c in right.columns])
        if not mine or not others:
            return left.join(right.limit(0), F.lit(False))
        a = _bins(left.where("start <= end"), "start", "end", others, ("_lev", "_bin"))
        b = _bins(right.where(f"start{suffix} <= end{suffix}"), "start" + suffix, "end" + suffix, mine, ("_lev_2", "_bin_2"))
        own = F.expr(f"shiftright(CAST(greatest(start, start{suffix}) AS BIGINT), _lev)")
        # a pair meets in the coarser level of its two; both are columns, as this is asked of each candidate
        level = F.greatest("_own_lev", "_own_lev_2")
        on = (F.col("chr") == F.col("chr" + suffix)) & (F.col("_lev") == F.col("_lev_2")) & (F.col("_bin") == F.col("_bin_2")) & (F.col("start") <= F.col("end" + suffix)) & (F.col("start" + suffix) <= F.col("end")) & (F.col("_bin") == own) & (F.col("_lev") == level)
        return a.join(b, on).drop("_lev", "_bin", "_lev_2", "_bin_2", "_own_lev", "_own_lev_2")
    hits = overlap_join(left.select("chr", "start", "end").distinct(), right.select("chr", "start", "end"), levels=levels).select("chr", "start", "end").distinct()
    keys = hits.withColumnsRenamed({"chr": "_c", "start": "_s", "end": "_e"})
    return left.join(keys, (F.col("chr") == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), how)


def islands(df: DataFrame, gap: int = 0, by: tuple[str, ...] = ("chr",), tile: int = 1 << 16) -> DataFrame:
    """df with `island`, the number of its merged interval within `by`; intervals at most gap bases apart share one.

    Running maxima go over tiles of the reference, each with the largest end before it carried in, so a chromosome is
    many tasks. What is carried is a row a tile.
    """
    key = [*by, "_tile"]
    t = df.withColumn("_tile", F.floor(F.col("start") / tile))
    earlier = Window.partitionBy(*by).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    ends = t.groupBy(*key).agg(F.max("end").alias("_m")).withColumn("_carry", F.max("_m").over(earlier)).drop("_m")
    order = Window.partitionBy(*key).orderBy("start", "end")
    w = t.join(ends, key)
    before = F.greatest("_carry", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("_new", F.when(F.col("start") - 1 - before <= gap, 0).otherwise(1))
    starts = w.groupBy(*key).agg(F.sum("_new").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    number = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return w.withColumn("_number", number).join(starts, key).withColumn("island", F.col("_offset") + F.col("_number")).drop("_tile", "_carry", "_new", "_number", "_offset")


def merge(df: DataFrame, gap: int = 0, *aggregates: Column) -> DataFrame:
    """chr, start, end of the merged intervals, and any aggregates over what was merged."""
    return islands(df, gap).groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggregates).drop("island")


def merge_named(df: DataFrame, gap: int = 0) -> DataFrame:
    """Merged intervals whose name joins the names of what was merged by "+", in order."""
    own = F.coalesce(F.col("name"), F.concat("chr", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    named = df.withColumn("_row", F.struct("start", "end", own.alias("name")))
    return merge(named, gap, F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda r: r["name"]), "+").alias("name"))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left intervals cut to each part that the merged right side covers; left columns stay."""
    j = overlap_join(left, checkpoint(merge(right)))
    return j.withColumn("_s", F.greatest("start", "start_2")).withColumn("end", F.least("end", "end_2")).withColumn("start", F.col("_s")).select(*left.columns)


#: merged intervals, at most, that every task gets whole (16 bytes each)
EVERYWHERE = 1 << 20


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """The parts of the left intervals that the right side leaves; left columns stay.

    Hits of a left row are gathered from merged intervals, so at most one for each gap between them and one more. Up to
    EVERYWHERE of them go to all tasks, and the left side stays where it is.
    """
    merged = checkpoint(merge(right))
    if merged.count() <= EVERYWHERE:
        return _subtract_few(left, merged)
    place = ["chr", "start", "end"]
    hits = overlap_join(left.select(*place).distinct(), merged)
    cuts = hits.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct(F.col("start_2").alias("s"), F.col("end_2").alias("e")))).alias("_cuts"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    c = left.join(cuts, place, "left").withColumn("_cuts", F.coalesce(F.transform("_cuts", lambda x: F.struct(x["s"].cast("long").alias("s"), x["e"].cast("long").alias("e"))), none))
    heads = F.concat(F.array(F.col("start").cast("long")), F.transform("_cuts", lambda x: x["e"] + 1))
    tails = F.concat(F.transform("_cuts", lambda x: x["s"] - 1), F.array(F.col("end").cast("long")))
    pieces = F.filter(F.arrays_zip(heads.alias("s"), tails.alias("e")), lambda p: p["s"] <= p["e"])
    return c.withColumn("_p", F.explode(pieces)).select(*[F.col("_p.s").alias(k) if k == "start" else F.col("_p.e").alias(k) if k == "end" else F.col(k) for k in left.columns])


def _subtract_few(left: DataFrame, merged: DataFrame) -> DataFrame:
    """`subtract` where the merged intervals are few; those of a chromosome are disjoint, and searched by halving."""
    t = merged.where("chr IS NOT NULL").select("chr", F.col("start").cast("long"), F.col("end").cast("long")).toArrow().sort_by([("chr", "ascending"), ("start", "ascending")]).combine_chunks()
    chrs, starts, ends = t.column("chr").to_pylist(), t.column("start").to_numpy(), t.column("end").to_numpy()
    cuts = np.flatnonzero([a != b for a, b in zip(chrs, [None, *chrs])]).tolist()
    known = left.sparkSession.sparkContext.broadcast({chrs[a]: (starts[a:b], ends[a:b]) for a, b in zip(cuts, [*cuts[1:], len(chrs)])})
    schema = StructType([StructField(f.name, LongType(), f.nullable) if f.name in ("start", "end") else f for f in left.schema.fields])

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.filter(pc.and_(pc.is_valid(t.column("start")), pc.is_valid(t.column("end")))).combine_chunks()
            if not t.num_rows:
                continue
            beg, end = (t.column(k).cast(pa.int64()).to_numpy() for k in ("start", "end"))
            first, hits = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
            own = t.column("chr").combine_chunks().dictionary_encode()
            code = own.indices.fill_null(-1).to_numpy() if own.indices.null_count else own.indices.to_numpy()
            for k, name in enumerate(own.dictionary.to_pylist()):
                if name in known.value:
                    s, e = known.value[name]
                    rows = np.flatnonzero((code == k) & (beg <= end))
                    first[rows] = np.searchsorted(e, beg[rows])
                    hits[rows] = np.searchsorted(s, end[rows], "right") - first[rows]
            row = np.repeat(np.arange(t.num_rows), hits + 1)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(hits + 1) - hits - 1, hits + 1)
            a, b = beg[row], end[row]
            for k, name in enumerate(own.dictionary.to_pylist()):
                if name in known.value:
                    s, e = known.value[name]
                    later = np.flatnonzero((code[row] == k) & (piece > 0))
                    a[later] = e[first[row[later]] + piece[later] - 1] + 1
                    sooner = np.flatnonzero((code[row] == k) & (piece < hits[row]))
                    b[sooner] = s[first[row[sooner]] + piece[sooner]] - 1
            kept = np.flatnonzero(a <= b)
            out = t.take(pa.array(row[kept])).combine_chunks()
            new = {"start": pa.array(a[kept]), "end": pa.array(b[kept])}
            yield from pa.table([new.get(n, out.column(n)) for n in out.column_names], names=out.column_names).to_batches()

    return left.mapInArrow(run, schema)


def complement(df: DataFrame, refs: DataFrame, one_base_tail: bool = True) -> DataFrame:
    """Gaps of each reference (name, len) that no interval covers; an unknown chromosome is an error.

    one_base_tail=False leaves out a gap of one base at a reference's end.
    """
    known = refs.select(F.col("name").alias("chr"), F.col("len").cast("long").alias("len"))
    merged = merge(df).join(known, "chr", "left").withColumn("chr", F.when(F.col("len").isNull(), F.raise_error(F.concat(F.lit("unknown chromosome: "), "chr"))).otherwise(F.col("chr")))
    order = Window.partitionBy("chr").orderBy("start")
    heads = merged.select("chr", (F.coalesce(F.lag("end").over(order), F.lit(0)) + 1).alias("start"), (F.col("start") - 1).alias("end"))
    last = known.join(merged.groupBy("chr").agg(F.max("end").alias("m")), "chr", "left")
    tails = last.select("chr", (F.coalesce("m", F.lit(0)) + 1).alias("start"), F.col("len").alias("end"))
    if not one_base_tail:
        tails = tails.where("start < end")
    return heads.union(tails).where("start <= end")


def divide(refs: DataFrame, step: int) -> DataFrame:
    """Tiles of `step` bases over each reference."""
    tiles = refs.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("len").cast("long"), F.lit(step).cast("long"))))
    return tiles.select(F.col("name").alias("chr"), "start", F.least(F.col("start") + step - 1, F.col("len")).alias("end"))


def in_region(df: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, within: bool = False) -> DataFrame:
    """Rows of a region, any part of which may be left out; within=True keeps only what lies inside it."""
    if chrom is not None:
        df = df.where(F.col("chr") == chrom)
    if start is not None:
        df = df.where((F.col("start") if within else F.col("end")) >= start)
    if end is not None:
        df = df.where((F.col("end") if within else F.col("start")) <= end)
    return df
