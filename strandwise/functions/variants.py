"""Variant fields, genotypes and alleles as column expressions."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(x: Column) -> Column:
    return x.isNull() | x.isin("", ".")


def parse_info(info: Column) -> Column:
    """map<string, array<string>>; a flag has an empty array, "." a null element."""

    def one(x):
        value = F.when(x.contains("="), F.transform(F.split(F.substring_index(F.substr(x, F.instr(x, "=") + 1), "\t", 1), ","), lambda v: F.nullif(v, F.lit(".")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.substring_index(x, "=", 1).alias("key"), value.alias("value"))

    entries = F.filter(F.split(info, ";"), lambda x: x != "")
    return F.when(~missing(info), F.map_from_entries(F.transform(entries, one)))


def format_info(info: Column) -> Column:
    """The text of such a map, in the order of its keys."""
    one = lambda e: F.when(F.size(e["value"]) == 0, e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",", ".")))
    return F.when(info.isNull() | (F.size(info) == 0), F.lit(".")).otherwise(F.array_join(F.transform(F.array_sort(F.map_entries(info)), one), ";"))


def split_field(x: Column, sep: str) -> Column:
    return F.when(~missing(x), F.split(x, sep))


def parse_sample(fmt: Column, sample: Column) -> Column:
    """map<string, array<string>> of a sample column by its FORMAT; trailing values may be left out."""
    values = F.split(sample, ":")
    each = F.transform(fmt, lambda k, i: F.struct(k.alias("key"), F.transform(F.split(F.get(values, i), ","), lambda v: F.nullif(v, F.lit("."))).alias("value")))
    return F.map_from_entries(each)


def format_sample(fmt: Column, sample: Column) -> Column:
    """The text of a sample, trailing missing values dropped."""
    each = F.transform(fmt, lambda k: F.coalesce(F.array_join(sample[k], ",", "."), F.lit(".")))
    return F.coalesce(F.nullif(F.regexp_replace(F.array_join(each, ":"), r"(:\.(,\.)*)+$", ""), F.lit("")), F.lit("."))


def parse_genotype(gt: Column) -> Column:
    """array<struct<allele, phased>>; a missing allele is null. Without a leading sign the first is phased if all others are."""
    signs, alleles = F.regexp_extract_all(gt, F.lit(r"([/|]?)([0-9]+|\.)"), F.lit(1)), F.regexp_extract_all(gt, F.lit(r"([/|]?)([0-9]+|\.)"), F.lit(2))
    all_phased = ~gt.contains("/")
    return F.transform(F.arrays_zip(signs.alias("s"), alleles.alias("a")), lambda x, i: F.struct(F.when(x["a"] != ".", x["a"].try_cast("int")).alias("allele"), F.when((i == 0) & (x["s"] == ""), all_phased).otherwise(x["s"] == "|").alias("phased")))


def format_genotype(gt: Column) -> Column:
    rest_phased = F.forall(F.slice(gt, 2, 1 << 30), lambda x: x["phased"])
    sign = lambda x: F.when(x["phased"], "|").otherwise("/")
    one = lambda x, i: F.concat(F.when((i == 0) & (x["phased"] == rest_phased), "").otherwise(sign(x)), F.coalesce(x["allele"].cast("string"), F.lit(".")))
    return F.array_join(F.transform(gt, one), "")


def unphase(gt: Column) -> Column:
    """A genotype's text with alleles in order and no phase; missing ones first."""
    return F.array_join(F.transform(F.array_sort(F.transform(parse_genotype(gt), lambda x: F.coalesce(x["allele"], F.lit(-1)))), lambda a: F.when(a < 0, ".").otherwise(a.cast("string"))), "/")


def biallelic_genotype(gt: Column, target: Column) -> Column:
    """The target allele becomes 1 and all others 0; missing ones and phases stay."""
    return format_genotype(F.transform(parse_genotype(gt), lambda x: F.struct(F.when(x["allele"].isNotNull(), (x["allele"] == target).cast("int")).alias("allele"), x["phased"].alias("phased"))))


def genotypes(ploidy: int, alts: int) -> list[list[int]]:
    """All genotypes in canonical order."""
    if not ploidy:
        return [[]]
    return [g + [a] for a in range(alts + 1) for g in genotypes(ploidy - 1, a)]


def genotype_index(alleles: Column, ploidy: int) -> Column:
    """Place of a genotype in canonical order (alleles of any order, as an array of that many)."""
    ordered, total = F.array_sort(alleles), F.lit(0)
    for k in range(1, ploidy + 1):
        a = F.get(ordered, F.lit(k - 1))
        term = a + k - 1
        choose = F.lit(1)
        for i in range(k):
            choose = choose * (term - i)
        total = total + F.floor(choose / int(comb(k, k) * _factorial(k)))
    return total.cast("int")


def _factorial(k: int) -> int:
    return 1 if k < 2 else k * _factorial(k - 1)


def biallelic_indices(ploidy: int, alts: int, target: int) -> list[int]:
    """Places of the genotypes of the reference and one alternative among those of all."""
    return [i for i, g in enumerate(genotypes(ploidy, alts)) if set(g) <= {0, target}]


BREAKEND = r"^([ACGTNacgtn]*|\.)([\[\]])(.+):([0-9]+)([\[\]])([ACGTNacgtn]*|\.)$"


def parse_breakend(alt: Column) -> Column:
    """struct<chr, pos, join, strand, bases> of a breakend; null for other alleles."""
    part = lambda i: F.regexp_extract(alt, BREAKEND, i)
    left = part(1) != ""
    return F.when(
        alt.rlike(BREAKEND),
        F.struct(part(3).alias("chr"), part(4).try_cast("long").alias("pos"), F.when(left, "after").otherwise("before").alias("join"), F.when((left & (part(2) == "[")) | (~left & (part(2) == "]")), "forward").otherwise("reverse").alias("strand"), F.when(left, part(1)).otherwise(part(6)).alias("bases")),
    )


def format_breakend(b: Column) -> Column:
    sign = F.when((b["join"] == "after") == (b["strand"] == "forward"), "[").otherwise("]")
    mate = F.concat(sign, b["chr"], F.lit(":"), b["pos"].cast("string"), sign)
    return F.when(b["join"] == "after", F.concat(b["bases"], mate)).otherwise(F.concat(mate, b["bases"]))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    hit = F.filter(at, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_max(hit), F.lit(0)))


def allele_type(ref: Column, alt: Column) -> Column:
    """no-call, spanning-deletion, unspecified, ref, id, snv, mnv, insertion, deletion, complete-insertion, breakend, complex or other."""
    r, a = F.upper(ref), F.upper(alt)
    n, m = F.length(r), F.length(a)
    before = common_prefix(r, a)
    after = common_prefix(F.reverse(r), F.reverse(a))
    kept = F.least(before + after, n, m)
    return (
        F.when(missing(alt), "no-call")
        .when(alt == "*", "spanning-deletion")
        .when(alt.isin("<*>", "<X>", "X"), "unspecified")
        .when(alt.rlike("^<.+>$"), "id")
        .when(alt.rlike(BREAKEND) | alt.rlike(r"^\.[ACGTNacgtn]+$|^[ACGTNacgtn]+\.$"), "breakend")
        .when(~alt.rlike("^[ACGTNacgtn]+$") | ~ref.rlike("^[ACGTNacgtn]+$"), "other")
        .when(r == a, "ref")
        .when((n == 1) & (m == 1), "snv")
        .when(n == m, F.when(kept == n - 1, "snv").otherwise("mnv"))
        .when((n < m) & (kept == n), F.when((n == 1) & (before == 0), "complete-insertion").otherwise("insertion"))
        .when((n > m) & (kept == m), "deletion")
        .otherwise("complex")
    )


def format_quality(qual: Column) -> Column:
    """A quality's text, whole numbers below 2^23 without a point."""
    whole = (qual % 1 == 0) & (F.abs(qual) < 8388608)
    return F.when(qual.isNull(), ".").when(whole, qual.cast("long").cast("string")).otherwise(qual.cast("string"))
