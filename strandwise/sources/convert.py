"""Readers, writers and conversion by format, and what kind a format is.

READERS and WRITERS are the points of extension: a function added to them is used by `read`, `write` and `convert`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignments as A
from . import bcf, bigwig, binary, cram, text

ALIGNMENTS, VARIANTS, SEQUENCES, READS = {"sam", "bam", "cram"}, {"vcf", "bcf"}, {"fasta", "2bit"}, {"fastq"}
KINDS = {k: kind for kind, names in (("alignments", ALIGNMENTS), ("variants", VARIANTS), ("sequences", SEQUENCES), ("reads", READS), ("features", {"bed", "gff3"}), ("values", {"wig", "bigwig"}), ("pileup", {"pileup"})) for k in names}

READERS = {
    "sam": text.read_sam, "bam": binary.read_bam, "cram": cram.read_cram, "vcf": text.read_vcf, "bcf": bcf.read_bcf, "fasta": text.read_fasta, "2bit": binary.read_twobit, "fastq": text.read_fastq,
    "bed": text.read_bed, "gff3": text.read_gff, "wig": text.read_wig, "bigwig": bigwig.read_bigwig, "pileup": text.read_pileup,
}


def _header(spark: SparkSession, path: str) -> dict:
    kind = text.file_type(path)
    return binary.bam_header(path) if kind == "bam" else cram.cram_header(path) if kind == "cram" else text.read_sam_header(spark, path)


def _meta(spark: SparkSession, path: str) -> dict:
    return bcf.bcf_meta(path) if text.file_type(path) == "bcf" else text.read_vcf_meta(spark, path)


WRITERS = {
    "sam": lambda df, path, header=None, **o: text.write_sam(df, path, header), "bam": lambda df, path, header=None, **o: binary.write_bam(df, path, header or {}, **o),
    "cram": lambda df, path, header=None, **o: cram.write_cram(df, path, header or {}, **o),
    "vcf": lambda df, path, meta=None, **o: text.write_vcf(df, path, meta or {}, **o), "bcf": lambda df, path, meta=None, **o: bcf.write_bcf(df, path, meta or {}),
    "fasta": text.write_fasta, "2bit": binary.write_twobit, "fastq": text.write_fastq, "bed": text.write_bed, "gff3": text.write_gff, "wig": text.write_wig, "pileup": text.write_pileup,
}


def kind_of(path: str) -> str | None:
    """alignments, variants, sequences, reads, features, values or pileup."""
    return KINDS.get(text.file_type(path))


def is_kind(path: str, kind: str) -> bool:
    """Is it a file of that format, or of that kind of format?"""
    return text.file_type(path) == kind or kind_of(path) == kind


def can_read(path: str) -> bool:
    return text.file_type(path) in READERS


def can_write(path: str) -> bool:
    return text.file_type(path) in WRITERS


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Reads by format (default: by extension)."""
    kind = kind or text.file_type(path)
    if kind not in READERS:
        raise ValueError(f"no reader for {path}")
    return READERS[kind](spark, path, **options)


def write(df: DataFrame, path: str, kind: str | None = None, **options) -> None:
    kind = kind or text.file_type(path)
    if kind not in WRITERS:
        raise ValueError(f"no writer for {path}")
    WRITERS[kind](df, path, **options)


def whole_sequences(df: DataFrame) -> DataFrame:
    """(name, sequence) of chunks (name, chunk, bases) of one file; in the order of their names."""
    if "sequence" in df.columns:
        return df.select("name", "sequence")
    return df.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bases"))), lambda x: x["bases"]), "").alias("sequence")).orderBy("name")


def convert(spark: SparkSession, source: str, target: str, **options) -> None:
    """One file as another format: of its own kind, alignments as reads, or reads as sequences."""
    a, b = text.file_type(source), text.file_type(target)
    kinds = KINDS.get(a), KINDS.get(b)
    if kinds == ("alignments", "alignments"):
        rows = read(spark, source).orderBy("ordinal")
        write(rows, target, header=_header(spark, source), **options)
    elif kinds == ("variants", "variants"):
        write(read(spark, source).orderBy("ordinal"), target, meta=_meta(spark, source))
    elif kinds == ("sequences", "sequences"):
        own = {"mask": True} | options
        write(whole_sequences(read(spark, source, **own)), target)
    elif kinds == ("alignments", "reads"):
        write(A.to_reads(read(spark, source).orderBy("ordinal"), options.get("style", "medium")), target)
    elif kinds == ("reads", "sequences"):
        write(read(spark, source).select("name", "sequence"), target)
    elif a == b and a in WRITERS:
        write(read(spark, source), target)
    else:
        raise ValueError(f"no conversion of {source} to {target}")


def split_reads(alignments: DataFrame, folder: str, style: str = "medium") -> None:
    """FASTQ of primary alignments in folders which=0 (single), 1 and 2 (first and last of a pair): one pass."""
    reads = A.to_reads(alignments, style)
    lines = F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality")
    reads.select(lines.alias("value"), "which").write.mode("overwrite").partitionBy("which").text(folder)
