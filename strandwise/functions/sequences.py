"""Bases and base qualities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(s: Column) -> Column:
    """Reverse complement; bases other than ATGCN become N, case is kept."""
    return F.translate(F.reverse(F.regexp_replace(s, "[^ATGCNatgcn]", "N")), "ATGCatgc", "TACGtacg")


def normalize_bases(s: Column) -> Column:
    """Upper case, with N for a dot."""
    return F.upper(F.translate(s, ".", "N"))


def recode(s: Column) -> Column:
    """ACGTN as the digits 1 to 5."""
    return F.translate(s, "ACGTNacgtn", "1234512345")


def phred_decode(q: Column, offset: int = 33) -> Column:
    """Characters to scores; null for "*"."""
    return F.when(q != "*", F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset))


def phred_encode(scores: Column, offset: int = 33) -> Column:
    """Scores to characters, clamped to 0..93."""
    return F.array_join(F.transform(scores, lambda x: F.chr(F.greatest(F.lit(0), F.least(F.lit(93), x)) + offset)), "")


def quality_sum(q: Column) -> Column:
    """Sum of scores; null for "*"."""
    return F.aggregate(phred_decode(q), F.lit(0), lambda a, x: a + x)


def read_sequence(seq: Column, flag: Column) -> Column:
    """The bases as they were read."""
    return F.when(flag.bitwiseAND(F.lit(16)) != 0, revcomp(seq)).otherwise(seq)


def read_quality(qual: Column, seq: Column, flag: Column) -> Column:
    """The qualities as they were read; a missing one is score 1 for each base."""
    given = F.when(qual == "*", F.repeat(F.lit('"'), F.length(seq))).otherwise(qual)
    return F.when(flag.bitwiseAND(F.lit(16)) != 0, F.reverse(given)).otherwise(given)


CASAVA = r"^@?([^:\s]+):(\d+):([^:\s]+):(\d+):(\d+):(\d+):(\d+)\s+([12]):([YN]):(\d+):(\S*)$"
CASAVA_OLD = r"^@?([^:\s]+):(\d+):(\d+):(\d+):(\d+)(?:#([^/\s]*))?(?:/([12]))?$"


def parse_read_name(name: Column) -> Column:
    """struct<version, instrument, run, flowcell, lane, tile, x, y, pair, filtered, control, index> of either naming scheme; null if neither."""
    # all groups by one match: none of them has a space, so a line feed parts them; a name that doesn't match stays as it
    # is. What is used more than once is a lambda's variable, as an expression would be evaluated for each use.
    with_value = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    groups = lambda regex, n: with_value(F.regexp_replace(name, regex, "\n".join(f"${i + 1}" for i in range(n))), lambda found: F.when(found != name, F.split(found, "\n")))
    names = ["instrument", "run", "flowcell", "lane", "tile", "x", "y", "pair", "filtered", "control", "index"]
    null = F.lit(None).cast("string")

    def struct(version: str, found: Column, places: list) -> Column:
        part = lambda i: F.when(F.get(found, F.lit(i)) != "", F.get(found, F.lit(i)))
        return F.when(found.isNotNull(), F.struct(F.lit(version).alias("version"), *[(null if i is None else part(i)).alias(k) for i, k in zip(places, names)]))

    old = lambda: with_value(groups(CASAVA_OLD, 7), lambda found: struct("1.0", found, [0, None, None, 1, 2, 3, 4, 6, None, None, 5]))
    return with_value(groups(CASAVA, 11), lambda found: F.coalesce(struct("1.8", found, list(range(11))), old()))


def read_name(qname: Column, flag: Column, style: str = "medium") -> Column:
    """qname with which read of the pair it is: long (" 1:N:0:"), medium ("/1") or short (none)."""
    which = F.shiftright(flag, 6).bitwiseAND(F.lit(3))
    if style == "short":
        return qname
    if style == "medium":
        return F.when(which.isin(1, 2), F.concat(qname, F.lit("/"), which.cast("string"))).otherwise(qname)
    filtered = F.when(flag.bitwiseAND(F.lit(512)) != 0, "Y").otherwise("N")
    return F.when(which.isin(1, 2), F.concat(qname, F.lit(" "), which.cast("string"), F.lit(":"), filtered, F.lit(":0:1"))).otherwise(qname)
