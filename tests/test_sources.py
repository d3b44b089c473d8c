"""Round trips and literals of the formats."""

import glob

import pytest

from strandwise.operators import alignments as A
from strandwise.operators import coverage, pileup
from strandwise.sources import binary, text

SAM = """@HD\tVN:1.4\tSO:coordinate
@SQ\tSN:ref\tLN:45
@SQ\tSN:ref2\tLN:40
@CO\ta comment
r001\t163\tref\t7\t30\t8M4I4M1D3M\t=\t37\t39\tTTAGATAAAGAGGATACTG\t*\tXX:B:S,12561,2,20,112
r002\t0\tref\t9\t30\t1S2I6M1P1I1P1I4M2I\t*\t0\t0\tAAAAGATAAGGGATAAA\t*
r003\t0\tref\t9\t30\t5H6M\t*\t0\t0\tAGCTAA\t*
r004\t0\tref\t16\t30\t6M14N1I5M\t*\t0\t0\tATAGCTCTCAGC\t*
r003\t16\tref\t29\t30\t6H5M\t*\t0\t0\tTAGGC\t*
r001\t83\tref\t37\t30\t9M\t=\t7\t-39\tCAGCGCCAT\t*
x1\t0\tref2\t1\t30\t20M\t*\t0\t0\taggttttataaaacaaataa\t????????????????????
x2\t0\tref2\t2\t30\t21M\t*\t0\t0\tggttttataaaacaaataatt\t?????????????????????
x3\t0\tref2\t6\t30\t9M4I13M\t*\t0\t0\tttataaaacAAATaattaagtctaca\t??????????????????????????
x4\t0\tref2\t10\t30\t25M\t*\t0\t0\tCaaaTaattaagtctacagagcaac\t?????????????????????????
x5\t0\tref2\t12\t30\t24M\t*\t0\t0\taaTaattaagtctacagagcaact\t????????????????????????
x6\t0\tref2\t14\t30\t23M\t*\t0\t0\tTaattaagtctacagagcaacta\t???????????????????????
"""


@pytest.fixture(scope="module")
def sam(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("sam") / "a.sam"
    p.write_text(SAM)
    return text.in_file_order(text.read_sam(spark, str(p))), text.read_sam_header(spark, str(p)), str(p)


def lines(path):
    return [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f).read().split("\n") if x]


def test_sam_literals(spark, sam):
    df, header, path = sam
    assert df.count() == 12 and header["SQ"][1] == {"SN": "ref2", "LN": 40} and header["CO"] == ["a comment"]
    assert [r["end"] for r in df.orderBy("ordinal").collect()] == [22, 18, 14, 40, 33, 45, 20, 22, 27, 34, 35, 36]
    refs = text.header_refs(spark, header)
    want = [0] * 6 + [1, 1, 3, 3, 3, 3, 3, 3, 2, 3, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 1, 1, 1, 2, 2, 2, 2, 1, 1, 1, 1, 1]
    assert [r.depth for r in coverage.depth(df, "ref", 1, 100, 45).orderBy("pos").collect()] == want
    want2 = [1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 6, 6, 6, 6, 6, 6, 6, 5, 5, 4, 4, 4, 4, 4, 3, 3, 3, 3, 3, 3, 3, 2, 1, 0, 0, 0, 0]
    assert [r.depth for r in coverage.depth(df, "ref2", 1, 40).orderBy("pos").collect()] == want2
    with pytest.raises(ValueError):
        coverage.depth(df, "ref", 0, 45)
    assert [r.level for r in A.add_levels(df).orderBy("ordinal").collect()] == [0, 1, 2, 2, 0, 0, 0, 1, 2, 3, 4, 5]
    pairs = A.make_pairs(df).collect()
    assert [(p.qname, p.first, p.second) for p in pairs] == [("r001", 0, 5)]
    assert A.sort_by_position(df, refs).count() == 12
    assert A.validate(df, refs).where("size(errors) > 0").count() == 0


def test_pileup_literals(sam):
    df, _, _ = sam
    rows = pileup.pileup(df, chrom="ref")
    got = {r.pos: (r["count"], r.bases) for r in pileup.pileup_text(rows).collect()}
    assert got[7] == (1, "^?T") and got[14][1] == "A+4AGAGA+2GGA$" and got[18] == (3, "A-1NA+2AA$A")
    assert got[22][0] == 2 and got[23][1] == ">" and got[35][1] == ">+1C"


def test_sam_and_bam_round_trip(spark, sam, tmp_path):
    df, header, path = sam
    text.write_sam(df.orderBy("ordinal"), f"{tmp_path}/out", header)
    assert lines(f"{tmp_path}/out") == [x.upper() if False else x for x in _upper(SAM)]
    bam = f"{tmp_path}/a.bam"
    binary.write_bam(df.orderBy("ordinal"), bam, header, index=True)
    assert binary.bam_header(bam) == header
    cols = [c for c in df.columns if c != "ordinal"]
    back = binary.read_bam(spark, bam)
    key = lambda d: sorted(map(str, d.select(*cols).collect()))
    assert key(back) == key(df)
    region = binary.read_bam(spark, bam, "ref2", 21, 22)
    assert sorted(r.qname for r in region.collect()) == ["x2", "x3", "x4", "x5", "x6"]
    assert binary.read_bam(spark, bam, "none").count() == 0


def _upper(sam):
    out = []
    for line in sam.strip().split("\n"):
        f = line.split("\t")
        if not line.startswith("@"):
            f[9] = f[9].upper()
        out.append("\t".join(f))
    return out


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track name=x\n#c\nchr1 10 100 n 5 + 10 100 0 2 10,20, 0,70,\nchr2\t0\t5\tm\t0\t.\t0\t5\t.\t1\t5\t0\n")
    df = text.read_bed(spark, f"{tmp_path}/a.bed")
    r = df.orderBy("chr").collect()
    assert (r[0].start, r[0].end, r[0].strand, r[0].block_sizes) == (11, 100, "forward", [10, 20])
    text.write_bed(df, f"{tmp_path}/o")
    assert sorted(map(str, text.read_bed(spark, f"{tmp_path}/o").collect())) == sorted(map(str, r))
    (tmp_path / "bad.bed").write_text("chr1 10 5\n")
    with pytest.raises(Exception, match="malformed"):
        text.read_bed(spark, f"{tmp_path}/bad.bed").collect()


VCF = """##fileformat=VCFv4.3
##contig=<ID=20,length=62435964>
##INFO=<ID=DP,Number=1,Type=Integer,Description="Total \\"Depth\\", all">
##INFO=<ID=AF,Number=A,Type=Float,Description="Allele Frequency">
##INFO=<ID=DB,Number=0,Type=Flag,Description="dbSNP">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
20\t14370\trs6\tG\tA,T\t29\tPASS\tDP=14;AF=0.5,.;DB\tGT:DP\t0|1:3\t./.
20\t17330\t.\tT\t.\t.\tq10;s50\t.\tGT\t0/0\t1/1
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    meta = text.read_vcf_meta(spark, f"{tmp_path}/a.vcf")
    df = text.read_vcf(spark, f"{tmp_path}/a.vcf")
    r = df.select("*", *text.typed_info(meta, ["DP", "AF", "DB"])).orderBy("pos").collect()
    assert (r[0].DP, r[0].AF, r[0].DB, r[0].alt) == (14, [0.5, None], True, ["A", "T"]) and (r[1].DP, r[1].DB, r[1].alt, r[1].filter) == (None, False, None, ["q10", "s50"])
    assert r[0].samples[0]["values"]["GT"] == ["0|1"]
    with pytest.raises(ValueError):
        text.typed_info(meta, ["ZZ"])
    text.write_vcf(df.orderBy("ordinal"), f"{tmp_path}/o", meta)
    assert lines(f"{tmp_path}/o") == VCF.strip().split("\n")


def test_fasta_fastq_twobit(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">ref some text\nAGCat\nNNgg\n>ref2\nacgt\n")
    whole = lambda mask: {(r.name, r.chunk): r.bases for r in text.read_fasta(spark, f"{tmp_path}/a.fa", mask, width=6).collect()}
    assert whole(True) == {("ref", 0): "AGCatN", ("ref", 1): "Ngg", ("ref2", 0): "acgt"} and whole(False)["ref", 1] == "NGG"
    assert text.fasta_index(open(f"{tmp_path}/a.fa", "rb")) == [("ref", 9, 15, 5, 6), ("ref2", 4, 32, 4, 5)]
    s = spark.createDataFrame([("ref", "AGCatNNgg"), ("ref2", "acgt")], "name string, sequence string")
    binary.write_twobit(s, f"{tmp_path}/a.2bit")
    assert sorted(map(tuple, binary.read_twobit(spark, f"{tmp_path}/a.2bit", mask=True).collect())) == [("ref", "AGCatNNgg"), ("ref2", "acgt")]
    text.write_fasta(s, f"{tmp_path}/o", 5)
    assert lines(f"{tmp_path}/o") == [">ref", "AGCat", "NNgg", ">ref2", "acgt"]
    q = spark.createDataFrame([("a/1", "ACGT", "IIII"), ("b", "GG", "#@")], "name string, sequence string, quality string")
    text.write_fastq(q, f"{tmp_path}/q", "gzip")
    assert sorted(map(tuple, text.read_fastq(spark, f"{tmp_path}/q/*.gz").collect())) == sorted(map(tuple, q.collect()))


def test_gff_wig_pileup(spark, sam, tmp_path):
    (tmp_path / "a.gff3").write_text("##gff-version 3.1\nctg%201\t.\texon\t1300\t1500\t.\t+\t.\tID=e1;Parent=m1,m2\nctg\tx\tCDS\t1\t5\t0.5\t-\t2\tNote=a%3Bb\n##FASTA\n>x\nACGT\n")
    df = text.read_gff(spark, f"{tmp_path}/a.gff3")
    got = {r.chr: r for r in df.collect()}
    assert got["ctg 1"].attributes["Parent"] == ["m1", "m2"] and got["ctg"].attributes["Note"] == ["a;b"] and got["ctg"].phase == 2
    text.write_gff(df, f"{tmp_path}/g")
    assert "ctg\tx\tCDS\t1\t5\t0.5\t-\t2\tNote=a%3Bb" in lines(f"{tmp_path}/g")
    (tmp_path / "a.wig").write_text("track type=wiggle_0\nvariableStep chrom=chr19 span=150\n100 1.5\n300 2\nfixedStep chrom=chr1 start=4 step=300 span=2\n7\n8\n")
    w = text.read_wig(spark, f"{tmp_path}/a.wig")
    want = [("chr1", 4, 5, 7.0), ("chr1", 304, 305, 8.0), ("chr19", 100, 249, 1.5), ("chr19", 300, 449, 2.0)]
    assert sorted(map(tuple, w.select("chr", "start", "end", "value").collect())) == want
    text.write_wig(w, f"{tmp_path}/w")
    assert sorted(map(tuple, text.read_wig(spark, f"{tmp_path}/w").select("chr", "start", "end", "value").collect())) == want
    piles = pileup.pileup_text(pileup.pileup(sam[0]))
    text.write_pileup(piles, f"{tmp_path}/p")
    back = text.read_pileup(spark, f"{tmp_path}/p")
    assert {(r.rname, r.pos): r["count"] for r in piles.collect()} == {(r.rname, r.pos): len(r.pile) for r in back.collect()}


def test_dispatch():
    assert text.file_type("a/b.vcf.gz") == "vcf" and text.file_type("x.fq.bz2") == "fastq" and text.file_type("x.zzz") is None
    for head, kind in ((b"BAM\x01", "bam"), (b"##fileformat=VCFv4.2\n", "vcf"), (b">a\nAC", "fasta"), (b"@r\nACG\n+\nIII", "fastq"), (b"@HD\tVN:1\n", "sam"), (b"chr1\t1\t5\n", "bed")):
        assert text.file_type_of(head) == kind


def test_twobit_sequences_are_read_at_their_own_places(spark, tmp_path):
    rows = [("a", "ACGTN"), ("b", "TTTTTTTT"), ("a", "GGGacgt")] + [(f"s{i}", "ACGT"[i % 4] * (i % 7)) for i in range(500)]
    path = str(tmp_path / "x.2bit")
    binary.write_twobit(spark.createDataFrame(rows, "name string, sequence string").coalesce(1), path)
    assert sorted((r.name, r.sequence) for r in binary.read_twobit(spark, path, mask=True).collect()) == sorted(rows)
    cut, binary.HELD = binary.HELD, 1
    try:  # more than one file a task, more than one batch
        binary.write_twobit(spark.createDataFrame(rows, "name string, sequence string").coalesce(1), path)
        assert sorted((r.name, r.sequence) for r in binary.read_twobit(spark, path, mask=True).collect()) == sorted(rows)
    finally:
        binary.HELD = cut


def test_pileup_lines_are_parsed_at_once(spark, tmp_path):
    path = tmp_path / "x.pileup"
    deep = 30_000
    path.write_text("\n".join([
        "r\t1\tN\t5\t^^A+2acG^>t$>-3NNN<$\t!I5#~", "r\t2\tg\t3\t.,-12nnnnnnnnnnnn$*\tIII", "r\t3\tN\t0\t\t", "", "r\t4\tN\t3\t^+A^-C+1tG$\tABC",
        *(f"d\t{i}\tN\t{deep}\t{'^]A' * deep}\t{'I' * deep}" for i in range(20)),
    ]) + "\n")
    rows = text.read_pileup(spark, str(path))
    p = {r.pos: [tuple(x) for x in r.pile] for r in rows.where("rname = 'r'").collect()}
    assert p[1] == [("A", False, 0, True, 61, False, "AC", None), ("G", False, 40, False, None, False, None, None), ("T", True, 20, True, 29, True, None, None), (">", False, 2, False, None, False, None, 3), (">", True, 93, False, None, True, None, None)]
    assert p[2] == [("G", False, 40, False, None, False, None, None), ("G", True, 40, False, None, True, None, 12), ("*", False, 40, False, None, False, None, None)]
    assert p[3] == []
    assert [(x[0], *x[3:]) for x in p[4]] == [("A", True, 10, False, None, None), ("C", True, 12, False, "T", None), ("G", False, None, True, None, None)]
    assert rows.where("rname = 'd'").selectExpr("sum(size(pile)) AS n").first().n == 20 * deep


def test_piles_move_packed_and_once(spark):
    from strandwise.plans import queries

    rows = pileup.pile_rows(spark.createDataFrame([("q", 0, "r", 5, 60, "4M", "*", 0, "ACGT", "IIII", 1)], "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, seq string, qual string, ordinal long"), fields=pileup.TEXT)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert "named_struct" not in plan(pileup.pileup_text(rows))
    assert moves(pileup.mpileup({"a": rows, "b": rows})) == 1
    assert [tuple(r)[1:] for r in pileup.pileup_text(rows).orderBy("pos").collect()] == [(5, "N", 1, "^]A", "I"), (6, "N", 1, "C", "I"), (7, "N", 1, "G", "I"), (8, "N", 1, "T$", "I")]
    assert "Join" not in plan(queries.QUERIES["pileup_overlap_qual"](spark, "/root/testdata/sf0.001"))


def test_bam_records_as_columns_are_those_of_one_by_one(tmp_path):
    import io
    import random
    import struct

    import pyarrow as pa

    rng, ids = random.Random(1), {"c1": 0, "c2": 1}

    def one(i):
        n = rng.choice([0, 1, 7, 10, 400])
        return {
            "qname": f"q{i}", "flag": rng.choice([0, 16, 4, 99]), "rname": rng.choice(["c1", "c2", "*"]), "pos": rng.randrange(10**5), "mapq": rng.randrange(255), "cigar": rng.choice(["10M", "3S7M", "5M3D5M", "*", "4M20N6M"]),
            "rnext": rng.choice(["=", "*", "c2"]), "pnext": rng.randrange(1000), "tlen": rng.randrange(-50, 50), "seq": "".join(rng.choice("ACGTNacgt=") for _ in range(n)) or "*",
            "qual": "*" if rng.random() < 0.3 or not n else "".join(chr(rng.randrange(33, 127)) for _ in range(n)), "options": [{"tag": "NM", "type": "i", "value": str(rng.randrange(10**5))}] if rng.random() < 0.3 else [],
        }

    rows = [one(i) for i in range(6000)]
    each = [binary.encode_record(r, ids) for r in rows]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([binary.BAM_ARROW.field(n) for n in rows[0]]))
    assert binary.encode_columns(batch, ids)[0] == b"".join(each)
    assert binary.encode_columns(batch.slice(100, 50), ids)[0] == b"".join(each[100:150])
    long = pa.RecordBatch.from_pylist([rows[0] | {"cigar": "1M1I" * 40_000}], schema=batch.schema)
    assert binary.encode_columns(long, ids) is None  # goes by encode_record
    raw = io.BytesIO()
    w = binary.BgzfWriter(raw)
    w.write(b"".join(each))
    w.close()
    src, want = binary.BgzfReader(raw), []
    for x in each:
        at = src.tell()
        want.append(binary.decode_record(src.read(struct.unpack("<i", src.read(4))[0]), list(ids)) | {"ordinal": at, "next": src.tell()})
    got = []
    for data, at, begs, nexts in binary._record_runs(raw, 0, None):
        columns = binary.decode_columns(data, at, list(ids), binary.BAM_ARROW.names) | {"ordinal": pa.array(begs, pa.int64()), "next": pa.array(nexts, pa.int64())}
        got += pa.RecordBatch.from_arrays([columns[n] for n in binary.BAM_NEXT.names], schema=binary.BAM_NEXT).to_pylist()
    assert got == want
    part = [o for _, _, begs, _ in binary._record_runs(raw, want[10]["ordinal"], want[4000]["ordinal"]) for o in begs]
    assert part == [r["ordinal"] for r in want[10:4000]]
