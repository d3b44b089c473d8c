"""SAM optional fields and the small languages inside them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = {
    "mate_cigar": "MC", "alignment_score": "AS", "barcode": "BC", "edit_distance": "NM", "mismatching_positions": "MD",
    "primary_to_alt_score": "pa", "supplementary": "SA", "alternative_hits": "XA", "suboptimal_score": "XS",
    "read_group": "RG", "reference_comment": "XR",
}


def parse(fields: Column) -> Column:
    """array<TAG:TYPE:VALUE> to array<struct<tag, type, value>>."""

    def one(x):
        parts = F.split(x, ":", 3)
        return F.struct(F.get(parts, F.lit(0)).alias("tag"), F.get(parts, F.lit(1)).alias("type"), F.get(parts, F.lit(2)).alias("value"))

    return F.transform(fields, one)


def to_fields(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"]))


def value(tags: Column, tag: str) -> Column:
    """The value of the first field with that tag, or null."""
    return F.get(F.filter(tags, lambda t: t["tag"] == tag), F.lit(0))["value"]


def numbers(value_: Column) -> Column:
    """A numeric array's elements; its first character names their type."""
    return F.transform(F.slice(F.split(value_, ","), 2, 1 << 30), lambda x: x.cast("double"))


def parse_md(md: Column) -> Column:
    """array<struct<kind, n, bases>>: match (n), mismatch (one base) or deletion."""
    parts = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))

    def one(x):
        number = x.rlike("^[0-9]+$")
        return F.struct(
            F.when(number, "match").when(x.startswith("^"), "deletion").otherwise("mismatch").alias("kind"),
            F.when(number, x.try_cast("int")).otherwise(F.length(F.ltrim(x, F.lit("^")))).alias("n"),
            F.when(~number, F.ltrim(x, F.lit("^"))).alias("bases"),
        )

    return F.transform(parts, one)


def parse_sa(sa: Column) -> Column:
    """array<struct<rname, pos, strand, cigar, mapq, nm>> of rname,pos,strand,CIGAR,mapQ,NM;.."""

    def one(x):
        p = F.split(x, ",")
        at = lambda i: F.get(p, F.lit(i))
        return F.struct(at(0).alias("rname"), at(1).try_cast("int").alias("pos"), at(2).alias("strand"), at(3).alias("cigar"), at(4).try_cast("int").alias("mapq"), at(5).try_cast("int").alias("nm"))

    return F.transform(F.filter(F.split(sa, ";"), lambda x: x != ""), one)


def parse_xa(xa: Column) -> Column:
    """array<struct<rname, strand, pos, cigar, nm>> of chr,+pos,CIGAR,NM;.."""

    def one(x):
        p = F.split(x, ",")
        at = lambda i: F.get(p, F.lit(i))
        return F.struct(at(0).alias("rname"), F.substring(at(1), 1, 1).alias("strand"), F.substring(at(1), 2, 20).try_cast("int").alias("pos"), at(2).alias("cigar"), at(3).try_cast("int").alias("nm"))

    return F.transform(F.filter(F.split(xa, ";"), lambda x: x != ""), one)
