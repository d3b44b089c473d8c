"""BCF and bigWig."""

import struct
import zlib

from strandwise.sources import bcf, bigwig, text

META = ["##fileformat=VCFv4.3", "##contig=<ID=c1,length=1000000>", "##contig=<ID=c2,length=2000000>", '##FILTER=<ID=q10,Description="low">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', '##INFO=<ID=AF,Number=A,Type=Float,Description="f">',
        '##INFO=<ID=DB,Number=0,Type=Flag,Description="b">', '##INFO=<ID=SV,Number=.,Type=String,Description="s">', '##INFO=<ID=END,Number=1,Type=Integer,Description="e">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">',
        '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">', '##FORMAT=<ID=GL,Number=G,Type=Float,Description="l">', '##FORMAT=<ID=FT,Number=1,Type=String,Description="t">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"]
ROWS = [
    "c1\t5\trs1\tA\tC,G\t30\tPASS\tDP=200;AF=0.5,.;DB\tGT:AD:GL:FT\t0|1:5,70000,.:-0.5,-1.25:ok\t./.:.:.:.",
    "c1\t9\t.\tACGTACGTACGTACGTACGT\t.\t.\t.\tSV=a,b\tGT:AD\t0/1/2:1,2\t1",
    "c1\t70000\t.\tN\t<DEL>\t1.5\tq10\tEND=90000\tGT\t.\t0/0",
    "c2\t1\t.\tT\tA\t8.5\tq10;PASS\t.\tGT\t1|1\t1/.",
]


def test_bcf_round_trip(spark, tmp_path):
    path = f"{tmp_path}/a.vcf"
    open(path, "w").write("\n".join(META + ROWS) + "\n")
    meta = text.read_vcf_meta(spark, path)
    v = text.read_vcf(spark, path)
    out = f"{tmp_path}/a.bcf"
    bcf.write_bcf(v.orderBy("ordinal").coalesce(1), out, meta)
    back = bcf.read_bcf(spark, out)
    assert bcf.bcf_meta(out) == meta
    lines = [r[0] for r in back.orderBy("ordinal").select(text.vcf_line(meta["columns"][9:])).collect()]
    want = [r.replace("./.:.:.:.", "./.").replace("0/1/2:1,2\t1", "0/1/2:1,2\t1") for r in ROWS]
    assert lines == want
    big = v.unionByName(v).unionByName(v).repartition(3)
    bcf.write_bcf(big, out, meta)
    assert bcf.read_bcf(spark, out).count() == 12
    bcf.write_bcf(v.orderBy("ordinal").coalesce(1), out, meta)
    bcf.build_bcf_index(spark, out)
    region = lambda *a: [(r.chr, r.pos) for r in bcf.read_bcf(spark, out, *a).orderBy("ordinal").collect()]
    assert region("c1", 80_000, 80_001) == [("c1", 70_000)] and region("c1", 6, 20) == [("c1", 9)] and region("c2") == [("c2", 1)] and region("c3") == []
    assert bcf.read_bcf(spark, out).count() == 4


def test_genotype_ints():
    for gt, ints in (("0/1", [2, 4]), ("1|0", [4, 3]), ("./.", [0, 0]), ("2", [6]), (".|3", [0, 9])):
        assert bcf.genotype_to_ints(gt) == ints
        assert bcf.ints_to_genotype(ints) == gt
    assert bcf.genotype_to_ints(None) == [0] and bcf.ints_to_genotype([0]) is None


def make_bigwig(path, e, packed):
    blocks = [(0, 10, 40, 1, [(10, 20, 1.5), (30, 40, -2.0)]), (0, 100, 131, 2, [(100, 3.0), (120, 4.0)]), (1, 0, 30, 3, [5.0, 6.0, 7.0])]
    data, placed, at = b"", [], 64 + 40
    bodies = []
    for chrom, start, end, kind, items in blocks:
        step, span = (0, 0) if kind == 1 else (0, 11) if kind == 2 else (10, 5)
        raw = struct.pack(e + "5I2BH", chrom, start, end, step, span, kind, 0, len(items))
        raw += b"".join(struct.pack(e + "2If", *x) if kind == 1 else struct.pack(e + "If", *x) if kind == 2 else struct.pack(e + "f", x) for x in items)
        bodies.append(zlib.compress(raw) if packed else raw)
    names = [("chr1", 1000), ("chrTwo", 500)]
    leaf = struct.pack(e + "2BH", 1, 0, 2) + b"".join(struct.pack(e + "8s2I", n.encode(), i, length) for i, (n, length) in enumerate(names))
    tree = struct.pack(e + "4I2Q", bigwig.TREE, 2, 8, 8, 2, 0) + leaf
    total = at + len(tree)
    data_at = total + 40
    offset = data_at + (4 if e == "<" else 4)
    for (chrom, start, end, *_), body in zip(blocks, bodies):
        placed.append((chrom, start, chrom, end, offset, len(body)))
        offset += len(body)
    index_at = offset
    head = struct.pack(e + "I", bigwig.INDEX)
    head += struct.pack(e + "IQ4IQ2I", 2, 3, 0, 10, 1, 30, 0, 1, 0)
    root_at = index_at + 48
    assert len(head) == 48
    child = [root_at + 4 + 2 * 24, 0]
    first = struct.pack(e + "2BH", 1, 0, 2) + b"".join(struct.pack(e + "4I2Q", *p) for p in placed[:2])
    child[1] = child[0] + len(first)
    second = struct.pack(e + "2BH", 1, 0, 1) + struct.pack(e + "4I2Q", *placed[2])
    root = struct.pack(e + "2BH", 0, 0, 2) + struct.pack(e + "4IQ", 0, 10, 0, 131, child[0]) + struct.pack(e + "4IQ", 1, 0, 1, 30, child[1])
    top = struct.pack(e + "I2H3Q2H2QIQ", bigwig.MAGIC, 4, 0, at, data_at, index_at, 0, 0, 0, total, 1000 if packed else 0, 0)
    body = top.ljust(at, b"\0") + tree + struct.pack(e + "Q4d", 5, -2.0, 7.0, 24.5, 99.0) + struct.pack(e + "I", 3) + b"".join(bodies) + head + root + first + second
    open(path, "wb").write(body)


def test_bigwig(spark, tmp_path):
    want = [("chr1", 11, 20, 1.5, "bedGraph", 10), ("chr1", 31, 40, -2.0, "bedGraph", 10), ("chr1", 101, 111, 3.0, "variableStep", 11), ("chr1", 121, 131, 4.0, "variableStep", 11), ("chrTwo", 1, 5, 5.0, "fixedStep", 5), ("chrTwo", 11, 15, 6.0, "fixedStep", 5), ("chrTwo", 21, 25, 7.0, "fixedStep", 5)]
    for e, packed in (("<", True), (">", False)):
        path = f"{tmp_path}/{packed}.bw"
        make_bigwig(path, e, packed)
        rows = lambda *a: sorted(map(tuple, bigwig.read_bigwig(spark, path, *a).collect()))  # noqa: E731, B023
        assert rows() == want
        assert rows("chr1", 35, 110) == want[1:3] and rows("chrTwo") == want[4:] and rows("chr9") == []
        with open(path, "rb") as raw:
            w = bigwig.BigWig(raw)
            assert w.names() == {0: ("chr1", 1000), 1: ("chrTwo", 500)} and w.summary()["max"] == 7.0
            assert len(w.blocks(0, 35, 99)) == 1


def test_bcf_without_index_is_split(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from strandwise.plans import roundtrips
    from strandwise.sources import bcf

    path = str(tmp_path / "x.bcf")
    rows = roundtrips._variants(spark, "/root/testdata/sf0.01")
    bcf.write_bcf(rows, path, roundtrips.META)
    load = lambda split: spark.read.format("bcf").option("path", path).option("split", split).load()
    assert load(10_000).rdd.getNumPartitions() == -(-os.path.getsize(path) // 10_000) > 5
    assert bcf.read_bcf(spark, path).count() == rows.count()
    a, b = (sorted(tuple(r) for r in load(n).collect()) for n in (10_000, 1 << 30))
    assert a == b
    places = spark.read.format("bcf").option("path", path).option("split", 10_000).option("places", "true").load()
    lines = load(1 << 30).select(F.split("value", "\t").alias("f"), "beg", "next").select(F.col("f")[1].cast("long").alias("pos"), F.length(F.col("f")[3]).alias("n"), "beg", "next")
    assert sorted(tuple(r) for r in places.select("start", "end", "beg", "next").collect()) == sorted((r.pos, r.pos + r.n - 1, r.beg, r.next) for r in lines.collect())
