"""Coverage depth: +1 where a read begins, -1 after it ends, then running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _region(start: int, end: int) -> None:
    if not 0 < start <= end:
        raise ValueError("a region needs 0 < start <= end")


def depth_runs(alignments: DataFrame, by: str = "rname", tile: int = 1 << 16) -> DataFrame:
    """rname, start, end, depth: maximal runs of positions of equal depth above zero.

    Steps are summed before the shuffle. Reads are cut at tile borders, so running sums go over (reference, tile) and a
    deep or long reference is spread over many tasks; runs that meet at a border are joined again.
    """
    cut = alignments.where(F.col("pos") > 0).select(F.col(by).alias("rname"), F.col("pos").cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    cut = cut.withColumn("tile", F.explode(F.sequence(F.floor((F.col("s") - 1) / tile), F.floor((F.col("e") - 1) / tile))))
    lo, hi = F.greatest("s", F.col("tile") * tile + 1), F.least("e", (F.col("tile") + 1) * tile)
    steps = cut.select("rname", "tile", F.explode(F.array(F.struct(lo.alias("pos"), F.lit(1).alias("d")), F.struct((hi + 1).alias("pos"), F.lit(-1).alias("d")))).alias("x")).select("rname", "tile", "x.*")
    steps = steps.groupBy("rname", "tile", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    order = Window.partitionBy("rname", "tile").orderBy("pos")
    runs = steps.select("rname", F.col("pos").alias("start"), (F.lead("pos").over(order) - 1).alias("end"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), "tile").where("depth > 0 AND end IS NOT NULL")
    # only runs at a border can continue in the next tile
    edge = (F.col("start") == F.col("tile") * tile + 1) | (F.col("end") == (F.col("tile") + 1) * tile)
    at = Window.partitionBy("rname").orderBy("start")
    inner, outer = runs.where(~edge).drop("tile"), runs.where(edge)
    same = (F.lag("end").over(at) == F.col("start") - 1) & (F.lag("depth").over(at) == F.col("depth"))
    outer = outer.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("g", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    outer = outer.groupBy("rname", "g", "depth").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("rname", "start", "end", "depth")
    return inner.unionByName(outer)


def depth(alignments: DataFrame, chrom: str, start: int, end: int, length: int | None = None) -> DataFrame:
    """pos, depth of each position of a region, zeros too; the region ends with the reference."""
    _region(start, end)
    end = end if length is None else min(end, length)
    inside = alignments.where((F.col("rname") == chrom) & (F.col("pos") <= end) & (F.col("end") >= start) & (F.col("pos") > 0))
    runs = depth_runs(inside.withColumn("pos", F.greatest("pos", F.lit(start))).withColumn("end", F.least("end", F.lit(end))))
    covered = runs.select(F.explode(F.sequence("start", "end")).alias("pos"), "depth")
    every = alignments.sparkSession.range(start, end + 1).withColumnRenamed("id", "pos")
    return every.join(covered, "pos", "left").select("pos", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
