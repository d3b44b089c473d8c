"""Operators on alignments: duplicates, mates, levels, orders, names and validation."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import cigar as C
from ..functions import flags, regions, sequences


def duplicates(alignments: DataFrame) -> DataFrame:
    """The alignments with `duplicate`.

    Of the heads of pairs (tlen > 0) at one (rname, pos, tlen) the best by sum of qualities, then mapq, then the later
    stays. A loser's tail is the first later candidate of its qname on the reference with tlen <= 0 that comes after
    the defeat: at the loser, if it came after a better one, else at the read that displaced it.
    """
    a = alignments.withColumn("_candidate", flags.multiple(F.col("flag")) & ~flags.both_unmapped(F.col("flag")) & (F.col("rnext") == "=") & (F.col("rname") != "*"))
    head = F.col("_candidate") & (F.col("tlen") > 0)
    heads = a.where(head).withColumn("_score", F.struct(F.coalesce(sequences.quality_sum(F.col("qual")), F.lit(-1)).alias("q"), "mapq", "ordinal"))
    group = Window.partitionBy("rname", "pos", "tlen").orderBy("ordinal")
    best = F.max("_score").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.max("_score").over(group.rowsBetween(Window.unboundedPreceding, -1))
    lost = heads.withColumn("_best", best).withColumn("_upto", upto).where(F.col("_score") != F.col("_best"))
    lost = lost.select("rname", "pos", "tlen", "qname", "ordinal", "_score", (F.col("_upto") > F.col("_score")).alias("_at_once"))
    displaced = lost.where("NOT coalesce(_at_once, false)").select("rname", "pos", "tlen", F.col("ordinal").alias("o"), F.col("_score").alias("s"), "qname")
    leaders = heads.withColumn("_upto", upto).where(F.col("_upto").isNull() | (F.col("_score") > F.col("_upto"))).select("rname", "pos", "tlen", F.col("ordinal").alias("_by"), F.col("_score").alias("_bs"))
    # each leader but the last is displaced by the next leader
    leaders = leaders.withColumn("_next", F.lead("_by").over(Window.partitionBy("rname", "pos", "tlen").orderBy("_by")))
    displaced = displaced.join(leaders.select("rname", "pos", "tlen", F.col("_by").alias("o"), "_next"), ["rname", "pos", "tlen", "o"]).select("rname", "qname", F.col("o").alias("loser"), F.col("_next").alias("_defeat"))
    at_once = lost.where("coalesce(_at_once, false)").select("rname", "qname", F.col("ordinal").alias("loser"), F.col("ordinal").alias("_defeat"))
    losers = at_once.unionByName(displaced)
    released = losers.groupBy("rname", "qname").agg(F.min("_defeat").alias("_defeat"))
    tails = a.where(F.col("_candidate") & (F.col("tlen") <= 0)).select("rname", "qname", "ordinal").join(released, ["rname", "qname"]).where(F.col("ordinal") > F.col("_defeat"))
    tails = tails.groupBy("rname", "qname").agg(F.min("ordinal").alias("ordinal")).select("ordinal")
    marked = losers.select(F.col("loser").alias("ordinal")).union(tails).distinct().withColumn("duplicate", F.lit(True))
    return a.drop("_candidate").join(marked, "ordinal", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def dedupe(alignments: DataFrame, remove: bool = True) -> DataFrame:
    """Duplicates removed, or marked by flag 1024. Reads without a reference are dropped."""
    d = duplicates(alignments).where(F.col("rname") != "*")
    if remove:
        return d.where("NOT duplicate").drop("duplicate")
    return d.withColumn("flag", F.when(F.col("duplicate"), F.col("flag").bitwiseOR(F.lit(1024))).otherwise(F.col("flag"))).drop("duplicate")


def mates(reads: DataFrame, alignments: DataFrame) -> DataFrame:
    """Pairs of a read and its primary mate: of one name, the other of the pair, at the read's next position."""
    b = alignments.where(flags.primary(F.col("flag"))).select(*[F.col(c).alias(f"mate_{c}") for c in alignments.columns])
    own = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    return reads.withColumn("_rnext", own).join(b, (F.col("qname") == F.col("mate_qname")) & (F.col("_rnext") == F.col("mate_rname")) & (F.col("pnext") == F.col("mate_pos")) & (flags.r1r2(F.col("flag")) + flags.r1r2(F.col("mate_flag")) == 3) & (flags.r1r2(F.col("flag")).isin(1, 2))).drop("_rnext")


def make_pairs(reads: DataFrame, alignments: DataFrame | None = None) -> DataFrame:
    """qname, first, second (ordinals) of primary pairs; a read alone is looked up in alignments and left out if its mate isn't there."""
    primary = reads.where(flags.multiple(F.col("flag")) & flags.primary(F.col("flag")))
    alone = primary.join(primary.groupBy("qname").agg(F.count("*").alias("_n")), "qname")
    both = alone.where("_n = 2").groupBy("qname").agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"))
    if alignments is not None:
        found = mates(alone.where("_n = 1").drop("_n"), alignments).select("qname", F.least("ordinal", "mate_ordinal").alias("a"), F.greatest("ordinal", "mate_ordinal").alias("b"))
        both = both.union(found)
    return both.select("qname", F.col("a").alias("first"), F.col("b").alias("second"))


def _color(batches):
    """Reads that come by reference, island and start, as `_read`, with their level."""
    island, free, busy, used = None, [], [], 0
    for b in batches:
        out = []
        for r, i, start, end in zip(*(b.column(k).to_pylist() for k in ("chr", "island", "start", "end"))):
            if (r, i) != island:
                island, free, busy, used = (r, i), [], [], 0
            while busy and busy[0][0] < start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                level = heapq.heappop(free)
            else:
                level, used = used, used + 1
            heapq.heappush(busy, (end, level))
            out.append(level)
        yield pa.RecordBatch.from_arrays([b.column("_read"), pa.array(out, pa.int32())], names=["_read", "level"])


def add_levels(alignments: DataFrame) -> DataFrame:
    """Alignments with `level`: the least row in which a read meets no other, first come first served by coordinate.

    Levels begin anew where no read before reaches, so each island of overlapping reads is a group of its own.
    """
    from .intervals import islands

    placed = alignments.where(F.col("pos") > 0)
    a = placed.select(F.struct(*alignments.columns).alias("_read"), F.col("rname").alias("chr"), F.col("pos").alias("start"), C.end(F.col("pos"), F.col("cigar")).alias("end"), "ordinal")
    # touching reads aren't overlapping: an island ends where the next read begins after all ends
    grouped = islands(a, gap=-1)

    # many small islands share a task, and stream through it in order; a large one is sorted with spilling
    streamed = grouped.repartition("chr", F.floor(F.col("island") / 64)).sortWithinPartitions("chr", "island", "start", "ordinal")
    schema = StructType([StructField("_read", alignments.schema), StructField("level", IntegerType())])
    levels = streamed.select("_read", "chr", "island", "start", "end").mapInArrow(_color, schema).select("_read.*", "level")
    return levels.unionByName(alignments.where(~F.coalesce(F.col("pos") > 0, F.lit(False))).withColumn("level", F.lit(None).cast("int")))


def sort_by_position(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """By reference in header order (none last), position, strand and file order; the list of references is small."""
    order = refs.select(F.col("name").alias("rname"), F.col("idx").alias("_idx"))
    return alignments.join(order, "rname", "left").orderBy(F.asc_nulls_last("_idx"), "pos", F.shiftright("flag", 4).bitwiseAND(F.lit(1)), "ordinal").drop("_idx")


def sort_by_name(alignments: DataFrame) -> DataFrame:
    return alignments.withColumn("_which", flags.r1r2(F.col("flag"))).orderBy("qname", "_which", "ordinal").drop("_which")


def sort_features(features: DataFrame) -> DataFrame:
    """By natural order of chromosomes, then start and end."""
    # a key of the sort that is no column is made anew for each comparison
    return features.withColumn("_order", regions.chromosome_order(F.col("chr"))).orderBy("_order", "start", "end").drop("_order")


def normalize_references(alignments: DataFrame) -> DataFrame:
    """rname and rnext in one form."""
    keep = lambda c: F.when(F.col(c).isin("*", "="), F.col(c)).otherwise(regions.normalize_chromosome(F.col(c)))
    return alignments.withColumn("rname", keep("rname")).withColumn("rnext", keep("rnext"))


def to_reads(alignments: DataFrame, style: str = "medium") -> DataFrame:
    """name, sequence, quality, which (0, 1, 2) of primary alignments, as they were read."""
    a = alignments.where(flags.primary(F.col("flag")))
    return a.select(sequences.read_name(F.col("qname"), F.col("flag"), style).alias("name"), sequences.read_sequence(F.col("seq"), F.col("flag")).alias("sequence"), sequences.read_quality(F.col("qual"), F.col("seq"), F.col("flag")).alias("quality"), F.when(flags.r1r2(F.col("flag")).isin(1, 2), flags.r1r2(F.col("flag"))).otherwise(0).alias("which"))


def genome_offsets(refs: DataFrame) -> DataFrame:
    """name, len, offset: where each reference begins in the whole genome; one row a reference."""
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return refs.select("name", "len", F.coalesce(F.sum("len").over(w), F.lit(0)).cast("long").alias("offset"))


def to_genome(df: DataFrame, refs: DataFrame, chrom: str = "chr", pos: str = "start") -> DataFrame:
    """df with `genome_pos`; null where the position isn't on the reference."""
    o = genome_offsets(refs).withColumnsRenamed({"name": "_name", "len": "_len", "offset": "_offset"})
    j = df.join(o, F.col(chrom) == F.col("_name"), "left")
    return j.withColumn("genome_pos", F.when((F.col(pos) >= 1) & (F.col(pos) <= F.col("_len")), F.col("_offset") + F.col(pos))).drop("_name", "_len", "_offset")


def from_genome(df: DataFrame, refs: DataFrame, pos: str = "genome_pos") -> DataFrame:
    """df with chr and start of a position in the whole genome; null beyond it. Positions meet references by bins, however many there are."""
    from .intervals import overlap_join

    at = df.select(F.col(pos).alias("_pos")).where(F.col("_pos").isNotNull()).distinct().select("_pos", F.lit("").alias("chr"), F.col("_pos").alias("start"), F.col("_pos").alias("end"))
    hits = overlap_join(at, _spans(refs)).select("_pos", F.col("name_2").alias("_name"), (F.col("_pos") - F.col("start_2") + 1).alias("_start"))
    j = df.join(hits, F.col(pos) == F.col("_pos"), "left")
    return j.withColumn("chr", F.col("_name")).withColumn("start", F.col("_start")).drop("_name", "_pos", "_start")


def _spans(refs: DataFrame) -> DataFrame:
    """References as intervals of one chromosome, the whole genome."""
    return genome_offsets(refs).where("len > 0").select(F.lit("").alias("chr"), (F.col("offset") + 1).alias("start"), (F.col("offset") + F.col("len")).alias("end"), "name")


def genome_regions(df: DataFrame, refs: DataFrame) -> DataFrame:
    """chr, start, end of the parts of genome intervals (gstart, gend) on each reference."""
    from .intervals import overlap_join

    whole = df.select(F.struct(*df.columns).alias("row"), F.lit("").alias("chr"), F.col("gstart").alias("start"), F.col("gend").alias("end"))
    j = overlap_join(whole, _spans(refs))
    offset = F.col("start_2") - 1
    return j.select("row.*", F.col("name_2").alias("chr"), (F.greatest("start", "start_2") - offset).alias("start"), (F.least("end", "end_2") - offset).alias("end"))


def _rule(bad: Column, path: str, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))


def alignment_errors(refs: DataFrame | None = None) -> Column:
    """array<struct<path, message>> of what is wrong with an alignment's fields."""
    c = F.col
    name = r"^[!-?A-~]{1,254}$"
    spelled = r"^(\*|([0-9]+[MIDNSHPX=])+)$"
    rules = [
        _rule(~c("qname").rlike(name), "qname", "must be 1 to 254 printable characters other than @"),
        _rule((c("rname") != "*") & ~regions.valid_name(c("rname")), "rname", "must be * or a reference name"),
        _rule(~c("rnext").isin("*", "=") & ~regions.valid_name(c("rnext")), "rnext", "must be *, = or a reference name"),
        _rule((c("pos") < 0) | (c("pos") > regions.LAST), "pos", "must be between 0 and 2147483647"),
        _rule((c("pnext") < 0) | (c("pnext") > regions.LAST), "pnext", "must be between 0 and 2147483647"),
        _rule((c("mapq") < 0) | (c("mapq") > 255), "mapq", "must be between 0 and 255"),
        _rule(~c("cigar").rlike(spelled), "cigar", "must be * or a CIGAR"),
        _rule(c("tlen").isNull(), "tlen", "must be a number"),
        _rule(~c("seq").rlike(r"^(\*|[A-Za-z=.]+)$"), "seq", "must be * or bases"),
        _rule((c("qual") != "*") & (F.length("qual") != F.length("seq")), "qual", "must be * or as long as seq"),
        _rule(c("cigar").rlike(spelled) & (c("cigar") != "*") & (c("seq") != "*") & (C.query_length(c("cigar")) != F.length("seq")), "cigar", "must be as long as seq"),
    ]
    return F.array_compact(F.array(*rules))


def validate(alignments: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Alignments with `errors`; references that the header lacks are errors too."""
    out = alignments.withColumn("errors", alignment_errors())
    if refs is None:
        return out
    known = refs.select(F.col("name").alias("rname"), F.lit(True).alias("_known"))
    missing = F.array(F.struct(F.lit("rname").alias("path"), F.lit("must be in the header").alias("message")))
    return out.join(known, "rname", "left").withColumn("errors", F.when(F.col("_known").isNull() & (F.col("rname") != "*"), F.concat("errors", missing)).otherwise(F.col("errors"))).drop("_known")


def check(alignments: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """The alignments; reading one with errors fails."""
    v = validate(alignments, refs)
    return v.withColumn("qname", F.when(F.size("errors") > 0, F.raise_error(F.to_json("errors"))).otherwise(F.col("qname"))).drop("errors")
