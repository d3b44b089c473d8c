"""Operators on variants and reference sequences.

A reference is (name, sequence), or chunks of it (name, chunk, bases); lookups are equi-joins on the chunk, so a
sequence is never moved whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions
from ..functions import variants as v
from ..storage import checkpoint

CHUNK = 1 << 16


def chunk(reference: DataFrame, width: int = CHUNK) -> DataFrame:
    """(name, chunk, bases, len): `width` bases a chunk, numbered from 0."""
    n = F.greatest(F.ceil(F.length("sequence") / width), F.lit(1)).cast("int")
    r = reference.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return r.select("name", "chunk", F.substr("sequence", F.col("chunk") * width + 1, F.lit(width)).alias("bases"), F.length("sequence").alias("len"))


def with_reference(df: DataFrame, reference: DataFrame, length: Column, width: int = CHUNK, start: Column | None = None, out: str = "_ref") -> DataFrame:
    """df (chr) with the reference's bases from `start` (default: pos) on, clamped to the sequence; null for an unknown name or nothing.

    The reference is whole sequences, or chunks of `width` bases as `read_fasta` gives them.
    """
    chunks = reference.select("name", "chunk", "bases") if "bases" in reference.columns else chunk(reference, width)
    first = F.col("pos") if start is None else start
    d = df.withColumn("_s", F.greatest(first.cast("long"), F.lit(1).cast("long"))).withColumn("_e", first.cast("long") + length - 1)
    asked = d.where("_s <= _e").select("chr", "_s", "_e").distinct().withColumn("chunk", F.explode(F.sequence(F.floor((F.col("_s") - 1) / width).cast("int"), F.floor((F.col("_e") - 1) / width).cast("int"))))
    parts = asked.join(chunks.withColumnRenamed("name", "chr"), ["chr", "chunk"])
    lo = F.greatest(F.col("_s") - 1 - F.col("chunk").cast("long") * width, F.lit(0)).cast("int")
    hi = F.least(F.col("_e") - F.col("chunk").cast("long") * width, F.lit(width)).cast("int")
    parts = parts.select("chr", "_s", "_e", F.struct("chunk", F.substr("bases", lo + 1, hi - lo).alias("b")).alias("p"))
    got = parts.groupBy("chr", "_s", "_e").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"]), "").alias(out))
    return d.join(got, ["chr", "_s", "_e"], "left").withColumn(out, F.nullif(F.col(out), F.lit(""))).select(*df.columns, out)


def sequence_dictionary(chunks: DataFrame) -> DataFrame:
    """name, len, md5 of each sequence's upper-case bases."""
    whole = chunks.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("chunk", "bases"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["bases"]), "")
    return whole.select("name", F.length(text).cast("long").alias("len"), F.md5(F.upper(text)).alias("md5"))


def same_ref(df: DataFrame, reference: DataFrame) -> DataFrame:
    """df with `same`: does ref match the reference; null where that has nothing there."""
    return with_reference(df, reference, F.length("ref")).withColumn("same", F.upper("_ref") == F.upper("ref")).drop("_ref")


def in_region(variants: DataFrame, chrom: str, start: int = 1, end: int = (1 << 32), within: bool = False) -> DataFrame:
    """Variants that overlap a region, by END of info where there is one; within=True wants pos + length(ref) inside."""
    if within:
        return variants.where((F.col("chr") == chrom) & (F.col("pos") >= start) & (F.col("pos") + F.length("ref") <= end))
    last = F.col("pos") + F.length("ref") - 1
    if "info" in variants.columns and dict(variants.dtypes)["info"] == "string":
        last = F.coalesce(F.nullif(F.regexp_extract("info", r"(?:^|;)END=(\d+)", 1), F.lit("")).cast("long"), last.cast("long"))
    return variants.where((F.col("chr") == chrom) & (F.col("pos") <= end) & (last >= start))


def genotype_places(ploidy: Column, alternative: Column) -> Column:
    """Places of the genotypes of the reference and one alternative, none to `ploidy` times, among those of all alleles.

    With j times the alternative k as the last of the alleles in order, the place is the sum of C(k + m - 1, m) over the
    last j of m = 1 .. ploidy.
    """
    k, none = alternative.cast("long"), F.array().cast("array<bigint>")
    term = lambda acc, m: F.floor(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1).cast("long")) * (k + m - 1) / m)
    terms = F.aggregate(F.sequence(F.lit(1).cast("long"), ploidy.cast("long")), none, lambda acc, m: F.concat(acc, F.array(term(acc, m))))
    add = lambda j: F.aggregate(F.slice(terms, ploidy.cast("int") - j + 1, j), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(1), ploidy.cast("int")), add))


def of_alternative(x: Column, number: Column, alternative: Column, ploidy: Column) -> Column:
    """What an array of one value an alternative (A), allele (R) or genotype (G) says of the reference and one alternative."""
    at = lambda i: F.get(x, i.cast("int"))
    return (
        F.when(number == "A", F.array(at(alternative - 1)))
        .when(number == "R", F.array(at(F.lit(0)), at(alternative)))
        .when(number == "G", F.transform(genotype_places(ploidy, alternative), at))
        .otherwise(x)
    )


def split_records(variants: DataFrame, meta: dict) -> DataFrame:
    """One row an alternative of variants as `read_vcf` gives them, by the declared Number of each INFO and FORMAT value.

    The ploidy is that of a sample's genotype, 2 without one.
    """
    numbers = lambda kind: F.create_map(*[F.lit(x) for f in meta.get(kind, []) for x in (f["id"], f.get("number", "."))]) if meta.get(kind) else F.create_map().cast("map<string,string>")
    info, fmt = numbers("info"), numbers("format")
    out = variants.withColumn("_n", F.size("alt")).select("*", F.posexplode_outer("alt").alias("_i", "_a")).withColumn("alt_index", F.col("_i") + 1)
    k, many = F.col("alt_index"), F.col("_n") > 1

    def sample(values):
        gt = F.get(values["GT"], F.lit(0))
        ploidy = F.when(gt.isNotNull(), F.greatest(F.size(v.parse_genotype(gt)), F.lit(1))).otherwise(2)
        return F.transform_values(values, lambda key, x: F.when(key == "GT", F.array(v.biallelic_genotype(gt, k))).otherwise(of_alternative(x, F.coalesce(fmt[key], F.lit(".")), k, ploidy)))

    out = out.withColumn("info", F.when(many, F.transform_values("info", lambda key, x: of_alternative(x, F.coalesce(info[key], F.lit(".")), k, F.lit(2)))).otherwise(F.col("info")))
    if "info_text" in out.columns:
        out = out.withColumn("info_text", F.when(many, F.lit(None)).otherwise(F.col("info_text")))
    if dict(variants.dtypes).get("samples", "void") != "void":
        out = out.withColumn("samples", F.when(many, F.transform("samples", lambda s: F.struct(s["name"].alias("name"), sample(s["values"]).alias("values")))).otherwise(F.col("samples")))
    return out.withColumn("alt", F.when(F.col("_a").isNotNull(), F.array("_a"))).drop("_n", "_i", "_a")


def split(variants: DataFrame, numbers: dict[str, str] | None = None, ploidy: int | None = None) -> DataFrame:
    """One row an alternative (alt as an array of one, alt_index from 1).

    gt becomes 1 for the alternative and 0 for others. Columns named in `numbers` are arrays of one value an
    alternative (A), allele (R) or genotype (G), and keep what concerns the reference and the alternative. The ploidy is
    that of gt by default, 2 without one.
    """
    own = F.greatest(F.size(v.parse_genotype(F.col("gt"))), F.lit(1)) if "gt" in variants.columns else F.lit(2)
    times = F.coalesce(own, F.lit(2)) if ploidy is None else F.lit(ploidy)
    variants = variants.withColumn("_ploidy", times)
    out = variants.withColumn("_n", F.size("alt")).select("*", F.posexplode_outer("alt").alias("_i", "_a"))
    out = out.withColumn("alt_index", F.col("_i") + 1)
    if "gt" in variants.columns:
        out = out.withColumn("gt", F.when(F.col("_n") > 1, v.biallelic_genotype(F.col("gt"), F.col("alt_index"))).otherwise(F.col("gt")))
    for name, number in (numbers or {}).items():
        out = out.withColumn(name, F.when(F.col("_n") > 1, of_alternative(F.col(name), F.lit(number), F.col("alt_index"), F.col("_ploidy"))).otherwise(F.col(name)))
    return out.withColumn("alt", F.when(F.col("_a").isNotNull(), F.array("_a"))).drop("_n", "_i", "_a", "_ploidy")


PLAIN = ("snv", "mnv", "insertion", "deletion", "complex")


def _with_end(info: Column, kind: str, end: Column) -> Column:
    """info with END replaced, if it has a number there."""
    text = end.cast("string")
    if kind == "string":
        return F.regexp_replace(info, F.lit(r"(^|;)END=\d+"), F.concat(F.lit("$1END="), text))
    return F.transform_values(info, lambda k, x: F.when((k == "END") & F.coalesce(F.get(x, F.lit(0)).try_cast("long").isNotNull(), F.lit(False)), F.array(text)).otherwise(x)) if kind == "map<string,array<string>>" else info


def shift(pos: int, ref: str, alts: list[str], left: str) -> tuple[int, str, list[str], bool, bool]:
    """(pos, ref, alts, is more of the left needed, was a right end trimmed) after trimming: right ends first, extended by the bases to the left, then left ends."""
    moved = False
    while True:
        ends = {a[-1:].upper() for a in [ref, *alts]}
        if len(ends) > 1 or "" in ends:
            break
        if min(map(len, [ref, *alts])) == 1:
            if not left:
                if pos > 1:
                    return pos, ref, alts, True, moved
                break
            b, left, pos = left[-1], left[:-1], pos - 1
            ref, alts = b + ref, [b + a for a in alts]
        ref, alts, moved = ref[:-1], [a[:-1] for a in alts], True
    while min(map(len, [ref, *alts])) > 1 and len({a[0].upper() for a in [ref, *alts]}) == 1:
        pos, ref, alts = pos + 1, ref[1:], [a[1:] for a in alts]
    return pos, ref, alts, False, moved


def realign(variants: DataFrame, reference: DataFrame, window: int = 100) -> DataFrame:
    """Variants trimmed and moved as far left as they go; those with other than plain alleles stay.

    The bases to the left come in windows: what still moves at the edge of its window is looked up again with one 16
    times as wide (up to a million bases), until nothing moves. END of `info` (text or map) follows the last base of what
    was moved, and is the first one without alternatives.
    """
    columns = variants.columns
    named = dict(variants.dtypes).get("info")
    kinds = F.transform("alt", lambda a: v.allele_type(F.col("ref"), a))
    plain = F.coalesce(F.forall(kinds, lambda k: k.isin(*PLAIN)), F.lit(False)) & (F.size("alt") > 0)
    v0 = variants.withColumn("_plain", F.coalesce(plain, F.lit(False)))
    none = F.col("alt").isNull() | (F.size("alt") == 0)
    still = v0.where("NOT _plain").withColumn("ref", F.when(none, F.substring("ref", 1, 1)).otherwise(F.col("ref")))
    if named:
        still = still.withColumn("info", F.when(none, _with_end(F.col("info"), named, F.col("pos"))).otherwise(F.col("info")))
    todo, done, size = v0.where("_plain").select(*columns, F.lit(False).alias("_moved")), still.select(*columns), window
    schema = f"pos {variants.schema['pos'].dataType.simpleString()}, ref string, alt array<string>, more boolean, moved boolean"

    @F.pandas_udf(schema)
    def move(pos: pd.Series, ref: pd.Series, alt: pd.Series, left: pd.Series) -> pd.DataFrame:
        rows = [shift(int(p), r, list(a), x or "") for p, r, a, x in zip(pos, ref, alt, left)]
        return pd.DataFrame(rows, columns=["pos", "ref", "alt", "more", "moved"])

    while True:
        near = with_reference(todo, reference, F.lit(1) * F.least(F.lit(size), F.col("pos") - 1), start=F.greatest(F.col("pos") - size, F.lit(1)), out="_left")
        moved = near.withColumn("_m", move("pos", "ref", "alt", "_left"))
        new = {k: F.col(f"_m.{k}") for k in ("pos", "ref", "alt")}
        if named:
            last = new["pos"] + F.length(new["ref"]) - 1
            new["info"] = F.when((F.col("_moved") | F.col("_m.moved")) & ~F.col("_m.more"), _with_end(F.col("info"), named, last)).otherwise(F.col("info"))
        # once: its rows are counted, and come twice
        moved = checkpoint(moved.select(*[new.get(k, F.col(k)).alias(k) for k in columns], (F.col("_moved") | F.col("_m.moved")).alias("_moved"), F.col("_m.more").alias("_more")))
        done = done.unionByName(moved.where("NOT _more").select(*columns))
        todo = moved.where("_more").drop("_more")
        if todo.isEmpty():
            return done
        size = min(size * 16, 16 * CHUNK)


def normalize(variants: DataFrame, reference: DataFrame, window: int = 100, meta: dict | None = None) -> DataFrame:
    """One row an alternative, each realigned; with meta-information, variants as `read_vcf` gives them."""
    return realign(split(variants) if meta is None else split_records(variants, meta), reference, window)


def variant_errors() -> Column:
    """array<struct<path, message>> of what is wrong with a variant's fields."""
    rule = lambda bad, path, message: F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    allele = r"^([ACGTNacgtn]+|\*|\.|<[^<>]+>|[ACGTNacgtn.]*[\[\]].+:[0-9]+[\[\]][ACGTNacgtn.]*|\.[ACGTNacgtn]+|[ACGTNacgtn]+\.)$"
    return F.array_compact(
        F.array(
            rule(~regions.valid_name(F.col("chr")), "chr", "must be a reference name"),
            rule((F.col("pos") < 0) | (F.col("pos") > regions.LAST), "pos", "must be between 0 and 2147483647"),
            rule(~F.col("ref").rlike("^[ACGTNacgtn]+$"), "ref", "must be bases"),
            rule(F.col("alt").isNotNull() & F.exists("alt", lambda a: ~a.rlike(allele)), "alt", "must be alleles"),
        )
    )


def declared_errors(meta: dict, samples: bool = True) -> Column:
    """array<struct<path, message>> of what is at odds with the meta-information, for variants as `read_vcf` gives them:

    names of filters, INFO and FORMAT that aren't declared, other numbers of values than declared, values of another
    type, and GT anywhere but first.
    """
    alts = F.coalesce(F.size("alt"), F.lit(0))
    issue = lambda bad, path, message: F.when(F.coalesce(bad, F.lit(False)), F.struct(path.alias("path"), F.lit(message).alias("message")))

    def table(kind, field):
        found = meta.get(kind, [])
        return F.create_map(*[F.lit(x) for f in found for x in (f["id"], f.get(field, "."))]) if found else F.create_map().cast("map<string,string>")

    def values_of(entries, kind, path, ploidy):
        numbers, types = table(kind, "number"), table(kind, "type")

        def one(e):
            n, k, size = numbers[e["key"]], types[e["key"]], F.size(e["value"])
            at = F.concat(F.lit(path), e["key"])
            genotypes = F.when(ploidy == 1, alts + 1).when(ploidy == 2, (alts + 1) * (alts + 2) / 2)
            wanted = F.when(n == "A", alts).when(n == "R", alts + 1).when(n == "G", genotypes).otherwise(n.try_cast("int"))
            alone = (size == 1) & F.get(e["value"], F.lit(0)).isNull()  # a dot stands for all values
            wrong = lambda t: F.exists(e["value"], lambda x: x.isNotNull() & x.try_cast(t).isNull())
            return F.coalesce(
                issue(n.isNull(), at, "must be declared"),
                issue((size != wanted) & ~alone, at, "must have as many values as declared"),
                issue(((k == "Integer") & wrong("int")) | ((k == "Float") & wrong("double")) | ((k == "Character") & F.exists(e["value"], lambda x: F.length(x) > 1)), at, "must be of its declared type"),
            )

        return F.transform(entries, one)

    none = F.array().cast("array<struct<path:string,message:string>>")
    known = F.array(F.lit("PASS"), *[F.lit(f["id"]) for f in meta.get("filter", [])])
    parts = [
        F.coalesce(F.transform(F.filter("filter", lambda x: ~F.array_contains(known, x)), lambda x: F.struct(F.concat(F.lit("filter/"), x).alias("path"), F.lit("must be declared").alias("message"))), none),
        F.coalesce(values_of(F.map_entries("info"), "info", "info/", F.lit(2)), none),
    ]
    if samples:
        def each(s):
            gt = F.get(s["values"]["GT"], F.lit(0))
            return values_of(F.filter(F.map_entries(s["values"]), lambda e: F.size(e["value"]) > 0), "format", "format/", F.when(gt.isNull(), F.lit(2)).otherwise(F.size(v.parse_genotype(gt))))

        parts.append(F.coalesce(F.flatten(F.transform("samples", each)), none))
        parts.append(F.array(issue(F.array_position("format", "GT") > 1, F.lit("format"), "must begin with GT")))
    return F.array_compact(F.concat(*parts))


def validate(variants: DataFrame, meta: dict | None = None) -> DataFrame:
    """The variants with `errors`; with meta-information also of what isn't as it declares."""
    own = variant_errors()
    if meta is not None:
        own = F.concat(own, declared_errors(meta, dict(variants.dtypes).get("samples", "void") != "void"))
    return variants.withColumn("errors", own)


def check(variants: DataFrame, meta: dict | None = None) -> DataFrame:
    """The variants; reading one with errors fails."""
    w = validate(variants, meta)
    return w.withColumn("ref", F.when(F.size("errors") > 0, F.raise_error(F.to_json("errors"))).otherwise(F.col("ref"))).drop("errors")
