"""Regions, chromosome names and binning numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION = r"^(.+?)(?::([0-9][0-9,]*)(?:-([0-9][0-9,]*))?)?$"
#: characters that a reference name may have
NAME = r"^[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*$"
LAST = 2**31 - 1


def parse_region(s: Column) -> Column:
    """struct<chr, start, end> of chr[:start[-end]], with commas in numbers allowed."""
    number = lambda i: F.nullif(F.regexp_replace(F.regexp_extract(s, REGION, i), ",", ""), F.lit("")).cast("long")
    return F.when(s.rlike(REGION), F.struct(F.regexp_extract(s, REGION, 1).alias("chr"), number(2).alias("start"), number(3).alias("end")))


def parse_region_strict(s: Column) -> Column:
    """As parse_region; null unless all of it is there and valid."""
    r = parse_region(s)
    return F.when(valid_region(r["chr"], r["start"], r["end"]), r)


def format_region(chrom: Column, start: Column, end: Column) -> Column:
    """chr, chr:start or chr:start-end, as far as it isn't null."""
    return F.when(start.isNull(), chrom).when(end.isNull(), F.concat(chrom, F.lit(":"), start.cast("string"))).otherwise(F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def valid_region(chrom: Column, start: Column, end: Column) -> Column:
    return F.coalesce(valid_name(chrom) & (start >= 1) & (end >= 1) & (start <= end), F.lit(False))


def valid_name(chrom: Column) -> Column:
    return F.coalesce(chrom.rlike(NAME), F.lit(False))


def overlaps(chr_a, start_a, end_a, chr_b, start_b, end_b) -> Column:
    return (chr_a == chr_b) & (start_a <= end_b) & (start_b <= end_a)


def subtract_region(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """array<struct<start, end>> of what one interval keeps of another, none to two pieces."""
    left = F.struct(start.alias("start"), F.least(end, other_start - 1).alias("end"))
    right = F.struct(F.greatest(start, other_end + 1).alias("start"), end.alias("end"))
    return F.filter(F.array(left, right), lambda p: p["start"] <= p["end"])


def normalize_chromosome(name: Column) -> Column:
    """Names of human chromosomes in one form (chr1.. chr22, chrX, chrY, chrM), leading zeros dropped; others as they are."""
    bare = F.regexp_replace(name, r"(?i)^chr(omosome)?_?", "")
    number = F.regexp_extract(bare, r"^0*([1-9][0-9]*)(.*)$", 1)
    rest = F.regexp_extract(bare, r"^0*([1-9][0-9]*)(.*)$", 2)
    letters = F.upper(F.regexp_extract(bare, r"(?i)^(X|Y|MT|M)($|_.*)", 1))
    tail = F.regexp_extract(bare, r"(?i)^(X|Y|MT|M)($|_.*)", 2)
    return (
        F.when(bare.rlike(r"^0*[1-9][0-9]*($|_)"), F.concat(F.lit("chr"), number, rest))
        .when(bare.rlike(r"(?i)^(X|Y|MT|M)($|_)"), F.concat(F.lit("chr"), F.when(letters == "MT", "M").otherwise(letters), tail))
        .otherwise(name)
    )


def is_primary_chromosome(name: Column) -> Column:
    return normalize_chromosome(name).rlike(r"^chr([1-9]|1[0-9]|2[0-2]|X|Y|M)$")


ORDER = r"(?i)^(chr)?([1-9][0-9]*|X|Y|MT|M)(\S*)"


def chromosome_order(name: Column) -> Column:
    """struct<number, suffix>: numbers first, then X, Y, M and MT, then other names."""
    key, suffix = F.upper(F.regexp_extract(name, ORDER, 2)), F.regexp_extract(name, ORDER, 3)
    number = F.when(key == "X", LAST - 4).when(key == "Y", LAST - 3).when(key == "M", LAST - 2).when(key == "MT", LAST - 1).when(key == "", LAST).otherwise(F.expr("1") * F.try_to_number(F.when(key.rlike("^[0-9]+$"), key), F.lit("9999999999")).cast("long"))
    return F.struct(number.cast("long").alias("number"), F.when(key == "", name).otherwise(suffix).alias("suffix"))


def first_bin(level: int) -> int:
    return (8**level - 1) // 7


def region_bin(start: Column, end: Column, shift: int = 14, depth: int = 5) -> Column:
    """Number of the smallest bin that holds the 1-based closed interval."""
    most = 1 << (shift + 3 * depth)
    b, e = F.greatest(start, F.lit(1)).cast("long") - 1, F.least(F.greatest(end, F.lit(1)), F.lit(most)).cast("long") - 1
    out = F.lit(0).cast("long")
    for level in range(1, depth + 1):
        s = shift + 3 * (depth - level)
        out = F.when(F.shiftright(b, s) == F.shiftright(e, s), F.lit(first_bin(level)) + F.shiftright(b, s)).otherwise(out)
    return out


def region_bins(start: Column, end: Column, shift: int = 14, depth: int = 5) -> Column:
    """Numbers of all bins that overlap the interval, bin 0 first."""
    most = 1 << (shift + 3 * depth)
    b, e = F.greatest(start, F.lit(1)).cast("long") - 1, F.least(F.greatest(end, F.lit(1)), F.lit(most)).cast("long") - 1
    each = [F.sequence(F.shiftright(b, shift + 3 * (depth - k)) + first_bin(k), F.shiftright(e, shift + 3 * (depth - k)) + first_bin(k)) for k in range(depth + 1)]
    return F.concat(*each)


def bin_level(number: Column, depth: int = 5) -> Column:
    out = F.lit(0)
    for level in range(1, depth + 1):
        out = F.when(number >= first_bin(level), level).otherwise(out)
    return out


def parent_bin(number: Column) -> Column:
    return F.shiftright(number - 1, 3)


def bin_start(number: Column, shift: int = 14, depth: int = 5) -> Column:
    """First position (from 1) of a bin."""
    out = F.lit(1).cast("long")
    for level in range(1, depth + 1):
        out = F.when(number >= first_bin(level), F.shiftleft((number - first_bin(level)).cast("long"), shift + 3 * (depth - level)) + 1).otherwise(out)
    return out


def linear_offset(pos: Column, shift: int = 14) -> Column:
    """Number of the linear index's window that holds a position."""
    return F.when(pos <= 0, 0).otherwise(F.shiftright(pos - 1, shift))


def virtual_offset(address: Column, within: Column) -> Column:
    return F.shiftleft(address.cast("long"), 16).bitwiseOR(within.cast("long"))


def virtual_address(offset: Column) -> Column:
    return F.shiftrightunsigned(offset, 16)


def virtual_within(offset: Column) -> Column:
    return offset.bitwiseAND(F.lit(0xFFFF))
