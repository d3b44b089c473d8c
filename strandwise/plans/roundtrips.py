"""Queries that go through files: relations are written in a format, read back, and compared with what they were."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import variants as VF
from ..operators import alignments as A
from ..operators import pileup
from ..operators import variants as V
from ..sources import bcf, binary, convert, cram, indexed, text
from ..storage import Folder, checkpoint
from . import derive
from .queries import CORRECTED, ENDS, REFERENCE, I, L, VR, _piles, query

c = F.col


def through(spark, write, read):
    """read(path) of what write(path) wrote; the files go, the result stays in the shared folder."""
    folder = Folder.new(spark, "files")
    path = folder.uri.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    try:
        write(path)
        return checkpoint(read(path))
    finally:
        folder.drop()


FIELDS = text.SAM_FIELDS
SAM_SQL = f"SELECT qname, flag::INT AS flag, rname, pos::INT AS pos, mapq::INT AS mapq, cigar, rnext, pnext::INT AS pnext, tlen::INT AS tlen, seq, qual FROM {L}"


def _reads(spark, d):
    none = F.array().cast("array<struct<tag:string,type:string,value:string>>")
    return A.sort_by_position(derive.alignments(spark, d), derive.refs(spark, d)).withColumn("options", none)


def _header():
    return {"HD": {"VN": "1.6", "SO": "coordinate"}, "SQ": [{"SN": f"chr{k}", "LN": derive.LENGTH} for k in range(1, 23)]}


query("file_sam", SAM_SQL)(lambda s, d: through(s, lambda p: text.write_sam(_reads(s, d), f"{p}/a.sam", _header()), lambda p: text.read_sam(s, f"{p}/a.sam").select(*FIELDS)))
query("file_bam", SAM_SQL)(lambda s, d: through(s, lambda p: binary.write_bam(_reads(s, d), f"{p}/a.bam", _header()), lambda p: binary.read_bam(s, f"{p}/a.bam", split=100_000).select(*FIELDS)))
query("file_bam_region", f"SELECT qname, pos::INT AS pos, flag::INT AS flag FROM {ENDS} WHERE rname = 'chr3' AND pos <= 90000 AND last >= 60000")(
    lambda s, d: through(s, lambda p: binary.write_bam(_reads(s, d), f"{p}/a.bam", _header(), index=True), lambda p: binary.read_bam(s, f"{p}/a.bam", "chr3", 60_000, 90_000, columns=("qname", "pos", "flag", "rname", "end")).select("qname", "pos", "flag"))
)


def _indexed_bam(s, d):
    def write(p):
        binary.write_bam(_reads(s, d), f"{p}/a.bam", _header())
        indexed.build_bai(s, f"{p}/a.bam")

    return through(s, write, lambda p: binary.read_bam(s, f"{p}/a.bam", "chr7", 1, 50_000, columns="region").groupBy("rname").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("end").alias("last")))


query("file_bai_build", f"SELECT rname, count(*) AS n, min(pos)::INT AS first, max(last)::INT AS last FROM {ENDS} WHERE rname = 'chr7' AND pos <= 50000 GROUP BY rname")(_indexed_bam)
query("file_bam_unplaced", f"SELECT count(*) AS n FROM {L} WHERE rname = '*'")(lambda s, d: through(s, lambda p: binary.write_bam(_reads(s, d), f"{p}/a.bam", _header(), index=True), lambda p: binary.read_bam(s, f"{p}/a.bam", "*", columns="queryname").agg(F.count("*").alias("n"))))
# a read without a place has no mapping quality in CRAM
CRAM_SQL = SAM_SQL.replace("mapq::INT AS mapq", "CASE WHEN flag & 4 <> 0 THEN 0 ELSE mapq END::INT AS mapq")
query("file_cram", CRAM_SQL)(lambda s, d: through(s, lambda p: cram.write_cram(_reads(s, d), f"{p}/a.cram", _header()), lambda p: cram.read_cram(s, f"{p}/a.cram").select(*FIELDS)))
query("file_cram_region", f"SELECT qname, pos::INT AS pos, flag::INT AS flag FROM {ENDS} WHERE rname = 'chr3' AND pos <= 90000 AND last >= 60000")(
    lambda s, d: through(s, lambda p: cram.write_cram(_reads(s, d), f"{p}/a.cram", _header(), index=True, records=500), lambda p: cram.read_cram(s, f"{p}/a.cram", chr="chr3", start=60_000, end=90_000).select("qname", "pos", "flag"))
)


def _converted(s, d):
    def write(p):
        text.write_sam(_reads(s, d), f"{p}/a.sam", _header())
        convert.convert(s, f"{p}/a.sam", f"{p}/a.bam")
        convert.convert(s, f"{p}/a.bam", f"{p}/b.cram")

    return through(s, write, lambda p: convert.read(s, f"{p}/b.cram").select(*FIELDS))


query("file_convert", CRAM_SQL)(_converted)
query("file_fastq", "SELECT name, sequence, quality FROM (SELECT CASE WHEN (flag >> 6) & 3 IN (1, 2) THEN qname || '/' || ((flag >> 6) & 3) ELSE qname END AS name, CASE WHEN flag & 16 <> 0 THEN translate(reverse(seq), 'ATGC', 'TACG') ELSE seq END AS sequence, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS quality "
      f"FROM {L} WHERE flag & 2304 = 0)")(lambda s, d: through(s, lambda p: text.write_fastq(A.to_reads(derive.alignments(s, d)), f"{p}/a.fq", "gzip"), lambda p: text.read_fastq(s, f"{p}/a.fq")))  # fmt: skip

# --- variants

META = {
    "fileformat": "VCFv4.3", "contig": [{"id": f"chr{k}", "length": str(derive.LENGTH)} for k in range(1, 23)],
    "info": [{"id": "DP", "number": "1", "type": "Integer", "description": "d"}, {"id": "AF", "number": "1", "type": "Float", "description": "f"}, {"id": "DB", "number": "0", "type": "Flag", "description": "b"}],
    "format": [{"id": "GT", "number": "1", "type": "String", "description": "g"}], "columns": ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S1"],
}


def _variants(spark, d):
    v = derive.variants(spark, d)
    sample = F.array(F.struct(F.lit("S1").alias("name"), F.create_map(F.lit("GT"), F.array("gt")).alias("values")))
    text_ = c("info")
    return v.select(
        "chr", "pos", c("id").cast("string").alias("id"), "ref", VF.split_field(c("alt"), ",").alias("alt"), F.lit(None).cast("double").alias("qual"), F.lit(None).cast("array<string>").alias("filter"),
        VF.parse_info(text_).alias("info"), F.array(F.lit("GT")).alias("format"), sample.alias("samples"), text_.alias("info_text"),
    ).orderBy("chr", "pos", "id")


def _read(v):
    return v.select("chr", "pos", c("id").cast("long").alias("id"), "ref", F.coalesce(F.array_join("alt", ","), F.lit(".")).alias("alt"), c("info_text").alias("info"), F.get(F.get("samples", F.lit(0))["values"]["GT"], F.lit(0)).alias("gt"))


VCF_SQL = "SELECT chr, pos::BIGINT AS pos, id, ref, alt, info, gt FROM " + VR
BCF_SQL = "SELECT chr, pos::BIGINT AS pos, id, ref, alt, replace(info, 'AF=0.0', 'AF=0') AS info, gt FROM " + VR
query("file_vcf", VCF_SQL)(lambda s, d: through(s, lambda p: text.write_vcf(_variants(s, d), f"{p}/a.vcf", META), lambda p: _read(text.read_vcf(s, f"{p}/a.vcf", META))))
query("file_bcf", BCF_SQL)(lambda s, d: through(s, lambda p: bcf.write_bcf(_variants(s, d), f"{p}/a.bcf", META), lambda p: _read(bcf.read_bcf(s, f"{p}/a.bcf"))))
query("file_vcf_region", VCF_SQL + " WHERE chr = 'chr5' AND pos <= 300000 AND pos + len(ref) - 1 >= 100000")(
    lambda s, d: through(s, lambda p: indexed.write_vcf_bgzf(_variants(s, d), f"{p}/a.vcf.gz", META, index=True), lambda p: _read(indexed.read_vcf_region(s, f"{p}/a.vcf.gz", "chr5", 100_000, 300_000)))
)


def _bcf_region(s, d):
    def write(p):
        bcf.write_bcf(_variants(s, d), f"{p}/a.bcf", META)
        bcf.build_bcf_index(s, f"{p}/a.bcf")

    return through(s, write, lambda p: _read(bcf.read_bcf(s, f"{p}/a.bcf", "chr5", 100_000, 300_000)))


query("file_bcf_region", BCF_SQL + " WHERE chr = 'chr5' AND pos <= 300000 AND pos + len(ref) - 1 >= 100000")(_bcf_region)
query("vcf_typed", f"SELECT id, regexp_extract(info, 'DP=(\\d+)', 1)::INT AS dp, info LIKE '%DB' AS db, gt FROM {VR}")(
    lambda s, d: text.typed_variants(_variants(s, d), META).select(c("id").cast("long").alias("id"), c("info.DP").alias("dp"), c("info.DB").alias("db"), F.get("samples", F.lit(0))["GT"].alias("gt"))
)

_WRONG = "CASE WHEN id % 7 = 0 THEN replace(info, 'DP=', 'DP=1,') WHEN id % 11 = 0 THEN concat(info, ';XX=1') WHEN id % 13 = 0 THEN replace(info, 'DP=', 'DP=x') ELSE info END"
query("validate_declared", f"SELECT id, CASE WHEN id % 7 = 0 THEN 'info/DP' WHEN id % 11 = 0 THEN 'info/XX' WHEN id % 13 = 0 THEN 'info/DP' ELSE '' END || CASE WHEN id % 5 = 0 THEN 'format/AD' ELSE '' END AS paths FROM {VR}")(
    lambda s, d: V.validate(
        _variants(s, d)
        .withColumn("info", VF.parse_info(F.expr(_WRONG.replace("info", "info_text"))))
        .withColumn("samples", F.transform("samples", lambda x: F.struct(x["name"].alias("name"), F.when(c("id") % 5 == 0, F.map_concat(x["values"], F.create_map(F.lit("AD"), F.array(F.lit("1"))))).otherwise(x["values"]).alias("values")))),
        META,
    ).select(c("id").cast("long").alias("id"), F.array_join(F.transform("errors", lambda e: e["path"]), "").alias("paths"))
)

# --- features, sequences, values, piles

query("file_bed", f'SELECT chr, pos_s AS "start", pos_e AS "end", id::VARCHAR AS name FROM {I}')(lambda s, d: through(s, lambda p: text.write_bed(derive.intervals(s, d).withColumn("name", c("id").cast("string")), f"{p}/a.bed", 4), lambda p: text.read_bed(s, f"{p}/a.bed").select("chr", "start", "end", "name")))


def _gff(s, d):
    none = lambda t: F.lit(None).cast(t)
    f = derive.intervals(s, d).select("chr", F.lit("a source").alias("source"), F.lit("exon").alias("type"), "start", "end", (c("id") % 7 / 2).alias("score"), F.lit("forward").alias("strand"), none("int").alias("phase"), F.create_map(F.lit("ID"), F.array(F.concat(F.lit("x;="), c("id").cast("string")))).alias("attributes"))
    return through(s, lambda p: text.write_gff(f, f"{p}/a.gff3"), lambda p: text.read_gff(s, f"{p}/a.gff3").select("chr", "source", "start", "end", "score", "strand", c("attributes")["ID"][0].alias("own")))


query("file_gff3", f"SELECT chr, 'a source' AS source, pos_s AS \"start\", pos_e AS \"end\", (id % 7 / 2)::DOUBLE AS score, 'forward' AS strand, 'x;=' || id AS own FROM {I}")(_gff)
_NAMED = derive.duck(REFERENCE)
query("file_fasta", f"SELECT name, sequence FROM {_NAMED}")(lambda s, d: through(s, lambda p: text.write_fasta(derive.relation(s, d, REFERENCE).select("name", "sequence"), f"{p}/a.fa", 60), lambda p: convert.whole_sequences(text.read_fasta(s, f"{p}/a.fa", width=100))))
query("file_twobit", f"SELECT name, sequence FROM {_NAMED}")(lambda s, d: through(s, lambda p: binary.write_twobit(derive.relation(s, d, REFERENCE).select("name", "sequence"), f"{p}/a.2bit"), lambda p: binary.read_twobit(s, f"{p}/a.2bit")))
WIG = "(SELECT DISTINCT chr, pos_s, (pos_s % 50)::DOUBLE / 2 AS value FROM " + I + ")"
query("file_wig", f'SELECT chr, pos_s AS "start", pos_s + 4 AS "end", value FROM {WIG}')(
    lambda s, d: through(s, lambda p: text.write_wig(derive.intervals(s, d).select("chr", "start", (c("start") + 4).alias("end"), (c("start") % 50 / 2).alias("value")).distinct(), f"{p}/a.wig"), lambda p: text.read_wig(s, f"{p}/a.wig").select("chr", "start", "end", "value"))
)
query("file_pileup", f"SELECT rname, p::INT AS pos, count(*)::INT AS count, min(base) AS least, max(mapq) FILTER (p = pos)::INT AS mapq FROM {CORRECTED} WHERE fq >= 13 GROUP BY rname, p")(
    lambda s, d: through(
        s,
        lambda p: text.write_pileup(pileup.pileup_text(_piles(s, d, fields=pileup.TEXT)), f"{p}/a.pileup"),
        lambda p: text.read_pileup(s, f"{p}/a.pileup").select("rname", "pos", "count", F.array_min(F.transform("pile", lambda x: x["base"])).alias("least"), F.array_max(F.transform("pile", lambda x: x["mapq"])).alias("mapq")),
    )
)
