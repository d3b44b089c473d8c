"""Mixing sources to target weights, in DataFrame operations only.

Sizes are words. Every document gets a hash-random key; documents are ranged by key within their source,
prefix sums are taken within a range and over the ranges' totals, and each source is cut at its exact budget
after its whole epochs.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; a null
doc_id is keyed by its text; repeated rows are separate documents, and rows of one id go by size, then (as documents) by
a hash of the row; an empty table gives no rows; extra columns are ignored, or pass as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, row_key

WORD = r"[^\x20\x09-\x0D]+"


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """60 hash-random bits of an id, or of the text where there is none; equal in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text.cast("string")), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(skey, source_size, target): shares by weight, none above `most` times its source.

    The sources that stop at their cap are a prefix in the order of cap / weight; `level` is what a weight of
    one gets when all sources before are capped. One row a source: the windows run over the list of sources.
    """
    order = Window.orderBy("skey")
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    upto, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = listed.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    listed = listed.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that stays below its cap sets the level of all that follow
    listed = listed.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole_by(by_ratio))
    listed = listed.withColumn("final", final)
    return listed.select("skey", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def whole_by(ordered):
    return ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix:", rows_per_range: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the columns of `keep`): the words of each document that the mix takes."""
    sized = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        random_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
        *[c for c in keep if c != "doc_id"],
    )
    sized = checkpoint(sized)  # the texts are read once
    bits = max(0, math.ceil(math.log2(max(1, sized.count() / rows_per_range))))
    sized = sized.withColumn("part", F.shiftright("key", 60 - bits) if bits else F.lit(0).cast("long"))
    parts = sized.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0))).drop("part_size")
    targets = source_targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, most)
    within = Window.partitionBy("skey", "part").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = sized.withColumn("upto", F.sum("size").over(within)).join(parts.join(targets, "skey"), ["skey", "part"])
    budget, whole = F.floor("target"), F.floor(F.floor("target") / F.greatest("source_size", F.lit(1)))
    rest = budget - whole * F.col("source_size")
    started = F.col("offset") + F.col("upto") - F.col("size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - started))
    return ranged.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[c for c in keep if c != "doc_id"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a document that is taken k times over, in part at last, comes k times, whole.

    So each source exceeds its budget by less than one document. The texts move once, to meet their counts.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", row_key(docs.columns).alias("row_key"))
    copies = F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    taken = mix(keyed, keep=("row_key",), **options).where("taken > 0").groupBy("row_key").agg(F.sum(copies).cast("int").alias("copies"))
    rows = keyed.select("row", "row_key").dropDuplicates(["row_key"]).join(taken.hint("merge"), "row_key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("epoch")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight < cap) * weight, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((budget // greatest(source_size, 1)) * size + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * source_size - (upto - size))))::BIGINT AS taken
FROM p
"""


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
