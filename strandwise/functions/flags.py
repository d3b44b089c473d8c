"""SAM flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = {
    1: "multiple", 2: "properly-aligned", 4: "unmapped", 8: "next-unmapped", 16: "reversed", 32: "next-reversed",
    64: "first", 128: "last", 256: "secondary", 512: "filtered-out", 1024: "duplicated", 2048: "supplementary",
}
#: unmapped, secondary, filtered out, duplicate or supplementary
NOT_PILED = 4 | 256 | 512 | 1024 | 2048


def has(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) != 0


def decode(flag: Column) -> Column:
    """Names of the set bits, in order."""
    return F.array_compact(F.array(*[F.when(has(flag, bit), F.lit(name)) for bit, name in NAMES.items()]))


def encode(names: Column) -> Column:
    """The flag of a set of names."""
    total = F.lit(0)
    for bit, name in NAMES.items():
        total = total + F.when(F.array_contains(names, name), bit).otherwise(0)
    return total


def multiple(flag):
    return has(flag, 1)


def properly_aligned(flag):
    return has(flag, 2)


def unmapped(flag):
    return has(flag, 4)


def both_unmapped(flag):
    return flag.bitwiseAND(F.lit(12)) == 12


def reversed_(flag):
    return has(flag, 16)


def r1(flag):
    return has(flag, 64)


def r2(flag):
    return has(flag, 128)


def secondary(flag):
    return has(flag, 256)


def primary(flag):
    return flag.bitwiseAND(F.lit(0x900)) == 0


def r1r2(flag: Column) -> Column:
    """0: neither, 1: first, 2: last, 3: both."""
    return F.shiftright(flag, 6).bitwiseAND(F.lit(3))


def pile_filter(flag: Column, cigar: Column, mapq: Column, min_mapq: int = 0) -> Column:
    """Reads that a pileup takes."""
    single_or_proper = ~multiple(flag) | properly_aligned(flag)
    return ~has(flag, NOT_PILED) & single_or_proper & (F.length(cigar) > 0) & (mapq >= min_mapq)
