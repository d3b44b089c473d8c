"""Conversion between formats, and regions of 2bit files."""

import glob
import random

import pytest

from strandwise.sources import binary, convert, text

SAM = """@HD\tVN:1.6\tSO:unknown
@SQ\tSN:c1\tLN:100
a\t99\tc1\t5\t30\t4M\t=\t20\t19\tACGT\tIIII\tNM:i:1
a\t147\tc1\t20\t30\t4M\t=\t5\t-19\tAAGG\tABCD
b\t16\tc1\t30\t0\t2M1I1M\t*\t0\t0\tTTTT\t*
c\t256\tc1\t31\t0\t4M\t*\t0\t0\tACGT\tIIII
"""


def test_alignments(spark, tmp_path):
    sam, bam, back = f"{tmp_path}/a.sam", f"{tmp_path}/a.bam", f"{tmp_path}/b.sam"
    open(sam, "w").write(SAM)
    convert.convert(spark, sam, bam, index=True)
    convert.convert(spark, bam, back)
    columns = [*text.SAM_FIELDS, "options"]
    assert sorted(map(str, convert.read(spark, back).select(columns).collect())) == sorted(map(str, convert.read(spark, sam).select(columns).collect()))
    assert text.read_sam_header(spark, back) == text.read_sam_header(spark, sam) == binary.bam_header(bam)
    fq = f"{tmp_path}/a.fq"
    convert.convert(spark, bam, fq)
    reads = {r["name"]: (r.sequence, r.quality) for r in convert.read(spark, fq).collect()}
    assert reads == {"a/1": ("ACGT", "IIII"), "a/2": ("CCTT", "DCBA"), "b": ("AAAA", reads["b"][1])}
    convert.split_reads(convert.read(spark, sam), f"{tmp_path}/split")
    assert sorted(g[len(str(tmp_path)) :] for g in glob.glob(f"{tmp_path}/split/which=*")) == ["/split/which=0", "/split/which=1", "/split/which=2"]
    convert.convert(spark, fq, f"{tmp_path}/a.fa")
    assert {r["name"]: r.bases for r in convert.read(spark, f"{tmp_path}/a.fa").collect()} == {k: v[0] for k, v in reads.items()}
    with pytest.raises(ValueError, match="no conversion"):
        convert.convert(spark, sam, f"{tmp_path}/a.bed")


def test_sequences(spark, tmp_path):
    rng = random.Random(1)
    sequences = {f"s{k}": "".join(rng.choice("ACGTacgtNn") for _ in range(n)) for k, n in enumerate((0, 1, 3, 4, 5, 1000))}
    df = spark.createDataFrame(list(sequences.items()), "name string, sequence string")
    path = f"{tmp_path}/a.2bit"
    binary.write_twobit(df.coalesce(2), path)
    assert {r["name"]: r.sequence for r in binary.read_twobit(spark, path, mask=True).collect()} == sequences
    s = sequences["s5"]
    for a, b in ((1, 1), (2, 9), (-3, 7), (990, 2000), (400, 403)):
        assert binary.read_twobit_region(path, "s5", a, b, mask=True) == s[max(a, 1) - 1 : b]
        assert binary.read_twobit_region(path, "s5", a, b) == s[max(a, 1) - 1 : b].upper()
    assert binary.read_twobit_region(path, "s5", 1001, 1002) is None and binary.read_twobit_region(path, "zz") is None
    convert.convert(spark, path, f"{tmp_path}/a.fa")
    convert.convert(spark, f"{tmp_path}/a.fa", f"{tmp_path}/b.2bit")
    assert {r["name"]: r.sequence for r in binary.read_twobit(spark, f"{tmp_path}/b.2bit", mask=True).collect()} == sequences


def test_kinds():
    assert convert.kind_of("x/a.vcf.gz") == "variants" and convert.kind_of("a.unknown") is None
    assert convert.is_kind("a.bam", "bam") and convert.is_kind("a.bam", "alignments") and not convert.is_kind("a.bam", "sam")
    assert convert.can_read("a.bw") and not convert.can_write("a.bw") and convert.can_write("a.bcf")
