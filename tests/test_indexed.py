"""Indexes, region reads and splits of compressed files."""

import random
import struct

import pytest

from strandwise.sources import indexed, text
from strandwise.sources.binary import BgzfWriter


def vcf_file(path, rng, rows=6000):
    lines = ["##fileformat=VCFv4.3", '##INFO=<ID=END,Number=1,Type=Integer,Description="End">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    found = []
    for chrom in ("chr2", "chr1", "chrX"):
        at = 0
        for _ in range(rows // 3):
            at += rng.randint(0, 400)
            ref = rng.choice(["A", "ACG", "T" * rng.randint(1, 40)])
            end = at + rng.choice([0, 90_000]) if rng.random() < 0.02 else None
            lines.append(f"{chrom}\t{at + 1}\t.\t{ref}\tC\t.\t.\t{'.' if end is None else f'END={end + 1}'}")
            found.append((chrom, at + 1, (at + len(ref)) if end is None else end + 1))
    with open(path, "wb") as out:
        w = BgzfWriter(out)
        for x in lines:
            w.write(x.encode() + b"\n")
            if rng.random() < 0.01:
                w._flush(len(w.buffer))
        w.close()
    return lines, found


def test_lines_split_anywhere(spark, tmp_path):
    path = f"{tmp_path}/x.vcf.gz"
    lines, _ = vcf_file(path, random.Random(1))
    for split in (700, 5000, 1 << 20):
        got = indexed.read_lines(spark, path, split=split).collect()
        assert [r.value for r in sorted(got, key=lambda r: r.beg)] == lines


def test_csi_build_and_region(spark, tmp_path):
    rng = random.Random(2)
    path = f"{tmp_path}/x.vcf.gz"
    _, found = vcf_file(path, rng)
    indexed.build_vcf_index(spark, path)
    index = indexed.read_index(path + ".csi")
    assert index["aux"]["names"] == ["chr2", "chr1", "chrX"] and (index["shift"], index["depth"]) == (14, 5)
    for chrom, start, end in (("chr1", 1, 1 << 31), ("chr1", 150_000, 150_500), ("chrX", 399_000, 400_000), ("chr2", 3, 3), ("chr9", 1, 10)):
        got = indexed.read_vcf_region(spark, path, chrom, start, end).collect()
        assert sorted((r.chr, r.pos) for r in got) == sorted((c, p) for c, p, e in found if c == chrom and p <= end and e >= start)
    assert len(indexed.region_chunks(index, 1, 150_000, 150_500)) >= 1
    whole = sum(b - a for a, b in indexed.region_chunks(index, 1, 1, 1 << 29))
    assert sum(b - a for a, b in indexed.region_chunks(index, 1, 150_000, 150_500)) < whole / 3


def test_tabix_and_crai(tmp_path):
    names = b"chr1\0chr2\0"
    raw = b"TBI\x01" + struct.pack("<8i", 2, 2, 1, 2, 0, 35, 0, len(names)) + names
    raw += struct.pack("<i", 1) + struct.pack("<Ii2Q", 4681, 1, 100 << 16, 200 << 16) + struct.pack("<iQ", 1, 100 << 16)
    raw += struct.pack("<ii", 0, 0)
    indexed.write_bgzf(raw, f"{tmp_path}/x.tbi")
    index = indexed.read_index(f"{tmp_path}/x.tbi")
    assert index["aux"]["names"] == ["chr1", "chr2"]
    assert indexed.region_chunks(index, 0, 5, 10) == [(100 << 16, 200 << 16)] and indexed.region_chunks(index, 1, 5, 10) == []
    entries = [(0, 1, 100, 10, 20, 30), (0, 101, 50, 10, 50, 30), (1, 1, 10, 90, 20, 30)]
    assert indexed.crai_entries(entries, 0, 100, 100) == entries[:1] and indexed.crai_entries(entries, 0, 90, 200) == entries[:2]
    assert indexed.bins_of(1, 1, 14, 5) == [0, 1, 9, 73, 585, 4681]
    assert indexed.merge_chunks([(5 << 16, 6 << 16), (1 << 16, 2 << 16), (2 << 16 | 5, 3 << 16)]) == [(1 << 16, 3 << 16), (5 << 16, 6 << 16)]


@pytest.mark.parametrize("packed", [False, True])
def test_fasta_regions(spark, tmp_path, packed):
    rng = random.Random(3)
    sequences = {f"s{k}": "".join(rng.choice("ACGTacgtn") for _ in range(n)) for k, n in enumerate((1, 59, 60, 61, 70_001))}
    raw = b"".join(b">%s some text\n" % n.encode() + b"".join(s[i : i + 60].encode() + b"\n" for i in range(0, len(s), 60)) for n, s in sequences.items())
    path = f"{tmp_path}/x.fa" + ".gz" * packed
    with open(path + ".fai", "w") as f:
        f.writelines("\t".join(map(str, r)) + "\n" for r in text.fasta_index(raw.splitlines(keepends=True)))
    if packed:
        indexed.write_bgzf(raw, path)
        indexed.write_gzi(path)
    else:
        open(path, "wb").write(raw)
    for n, s in sequences.items():
        for a, b in ((1, None), (-5, 10), (len(s), len(s) + 9), (max(1, len(s) // 2), len(s) // 2 + 77)):
            assert indexed.read_fasta_region(path, n, a, b, mask=True) == s[max(a, 1) - 1 : b]
    assert indexed.read_fasta_region(path, "s0", 2, 9) is None and indexed.read_fasta_region(path, "none") is None
    got = {}
    for r in indexed.fasta_chunks(spark, path, mask=True, width=1000).orderBy("name", "chunk").collect():
        got[r["name"]] = got.get(r["name"], "") + r.bases
    assert got == sequences


def test_typed_variants(spark, tmp_path):
    lines = ["##fileformat=VCFv4.3", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', '##INFO=<ID=AF,Number=A,Type=Float,Description="f">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="b">',
             '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="p">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2",
             "c\t5\t.\tT\tA,C\t.\t.\tDP=7;AF=0.5,0.25;DB\tGT:PL\t0/2:1,2,3,4,5,6\t0/1/2:0,1,2,3,4,5,6,7,8,9"]
    path = f"{tmp_path}/x.vcf"
    open(path, "w").write("\n".join(lines) + "\n")
    meta = text.read_vcf_meta(spark, path)
    v = text.read_vcf(spark, path)
    r = text.typed_variants(v, meta).first()
    assert (r.info.DP, r.info.AF, r.info.DB) == (7, [0.5, 0.25], True) and r.samples[0].PL == [1, 2, 3, 4, 5, 6] and r.samples[1].GT == "0/1/2"
    from strandwise.operators.variants import split_records

    a, b = split_records(v, meta).orderBy("alt_index").collect()
    assert (a.alt, a["info"]["AF"], a["info"]["DP"], b["info"]["AF"]) == (["A"], ["0.5"], ["7"], ["0.25"])
    assert (a.samples[0]["values"]["GT"], b.samples[0]["values"]["GT"]) == (["0/0"], ["0/1"])
    assert (a.samples[0]["values"]["PL"], b.samples[0]["values"]["PL"]) == (["1", "2", "3"], ["1", "4", "6"])
    assert (a.samples[1]["values"]["PL"], b.samples[1]["values"]["PL"]) == (["0", "1", "2", "3"], ["0", "4", "7", "9"])


def test_bam_splits_parts_and_index(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandwise.sources import binary

    rng = random.Random(4)
    rows, at = [], 0
    for i in range(9000):
        at = at + rng.randint(0, 60) if i % 3000 else 1
        n = rng.randint(1, 120)
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        placed = i < 8900
        rows.append((f"read{i}", 0 if placed else 4, f"c{i // 3000}" if placed else "*", at if placed else 0, 30, f"{n}M" if placed else "*", "*", 0, 0, seq, "".join(chr(33 + rng.randint(0, 60)) for _ in range(n)), [("NM", "i", str(i % 300)), ("XZ", "Z", "x" * (i % 5))], i))
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, options array<struct<tag:string,type:string,value:string>>, ordinal long"
    df = spark.createDataFrame(rows, schema).repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal")
    header = {"HD": {"VN": "1.6", "SO": "coordinate"}, "SQ": [{"SN": f"c{k}", "LN": 1_000_000} for k in range(3)]}
    path = f"{tmp_path}/a.bam"
    binary.write_bam(df, path, header)
    columns = schema.replace(", ordinal long", "").split(", ")
    names = [c.split()[0] for c in columns if " " in c][:11]
    want = [tuple(r[:11]) for r in rows]
    for split in (3000, 40_000, 1 << 30):
        got = binary.read_bam(spark, path, split=split)
        assert [tuple(r) for r in got.orderBy("ordinal").select(*names).collect()] == want
    assert got.select("options").orderBy(got.ordinal).first()["options"][0]["value"] == "0"
    indexed.build_bai(spark, path)
    built = binary.read_bai(open(path + ".bai", "rb").read())
    other = f"{tmp_path}/b.bam"
    binary.write_bam(df, other, header, index=True)
    for index in (built, binary.read_bai(open(other + ".bai", "rb").read())):
        assert len(index) == 3 and sum(len(linear) for _, linear in index) > 6
    for file in (path, other):
        for chrom, start, end in (("c1", 5000, 5200), ("c2", 1, None), ("c0", 80_000, 90_000)):
            got = binary.read_bam(spark, file, chrom, start, end, columns="coordinate")
            assert got.columns == ["rname", "pos", "flag", "end"]
            assert got.count() == sum(r[2] == chrom and r[3] + len(r[9]) - 1 >= start and (end is None or r[3] <= end) for r in rows)
        assert binary.read_bam(spark, file, "*", columns="queryname").count() == 100
    assert binary.read_bam(spark, path).where(F.col("seq").isNull()).count() == 0


def test_fastq_splits_and_gff_attributes(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    reads = []
    for i in range(400):
        n = rng.randint(1, 80)
        reads.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+IJ#") for _ in range(n))))
    path = f"{tmp_path}/a.fq"
    open(path, "w").write("".join(f"@{a}\n{b}\n+\n{q}\n" for a, b, q in reads))
    for split in (50, 333, 1 << 20):
        assert sorted(map(tuple, text.read_fastq(spark, path, split=split).collect())) == sorted(reads)
    row = spark.range(1).select(text.gff_target(F.lit("EST 1 21 -")).alias("t"), text.gff_gap(F.lit("M8 D3")).alias("g"), text.gff_reference(F.lit("EMBL:AA:1")).alias("d"))
    back = row.select(text.format_gff_target(F.col("t")), text.format_gff_gap(F.col("g")), text.format_gff_reference(F.col("d")), "t.*", "d.db").first()
    assert tuple(back) == ("EST 1 21 -", "M8 D3", "EMBL:AA:1", "EST", 1, 21, "reverse", "EMBL")
