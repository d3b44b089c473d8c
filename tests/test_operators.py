"""Operators and expressions against literals."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.functions import cigar, regions, sequences, variants
from strandwise.operators import alignments as A
from strandwise.operators import intervals as I  # noqa: E741
from strandwise.operators import pileup
from strandwise.operators import variants as V


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "chr string, start long, end long" + extra)


def spans(df):
    return sorted((r.chr, r.start, r.end) for r in df.collect())


def test_intervals(spark):
    a = frame(spark, [("c", 10, 40), ("c", 50, 80)])
    b = frame(spark, [("c", 30, 60), ("c", 70, 90)])
    assert spans(I.intersect(a, b)) == [("c", 30, 40), ("c", 50, 60), ("c", 70, 80)]
    assert spans(I.subtract(a, b)) == [("c", 10, 29), ("c", 61, 69)]
    m = frame(spark, [("c", 1, 10), ("c", 11, 20), ("c", 22, 30), ("d", 60_000, 140_000), ("d", 131_000, 131_100), ("d", 200_000, 200_001)])
    assert spans(I.merge(m)) == [("c", 1, 20), ("c", 22, 30), ("d", 60_000, 140_000), ("d", 200_000, 200_001)]
    named = I.merge_named(frame(spark, [("chr1", 1, 10, None), ("chr1", 4, 13, None)], ", name string")).collect()
    assert [(r.start, r.end, r["name"]) for r in named] == [(1, 13, "chr1:1-10+chr1:4-13")]
    refs = spark.createDataFrame([("chr1", 1000), ("chr2", 800)], "name string, len long")
    x = frame(spark, [("chr1", 1, 300), ("chr1", 900, 1000), ("chr2", 1, 300)])
    assert spans(I.complement(x, refs)) == [("chr1", 301, 899), ("chr2", 301, 800)]
    with pytest.raises(Exception, match="unknown chromosome"):
        I.complement(frame(spark, [("z", 1, 2)]), refs).collect()
    wide = frame(spark, [("c", 10, 50), ("c", 20, 30)])
    assert spans(I.intersect(wide, frame(spark, [("c", 5, 25), ("c", 40, 60)]))) == [("c", 10, 25), ("c", 20, 25), ("c", 40, 50)]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_expressions(spark):
    lit = F.lit
    assert one(spark, cigar.simplify(lit("3M2M1I")), cigar.reference_length(lit("4M20N6M2S")), cigar.end(lit(7), lit("*"))) == ("5M1I", 30, 7)
    assert one(spark, sequences.revcomp(lit("ACGTNacgx")), sequences.phred_decode(lit("*"))) == ("NcgtNACGT", None)
    r = one(spark, regions.parse_region(lit("chr1:1,000-2,000")), regions.parse_region(lit("chr1:2:3-4")), regions.parse_region(lit("chr1:1-")))
    assert [tuple(x) for x in r] == [("chr1", 1000, 2000), ("chr1:2", 3, 4), ("chr1:1-", None, None)]
    names = ["Y", "M_foo", "MT", "M", "22", "Z", "Un", "MT_foo", "X"]
    df = spark.createDataFrame([(n,) for n in names], "chr string")
    assert [x.chr for x in df.orderBy(regions.chromosome_order(F.col("chr"))).collect()] == ["22", "X", "Y", "M", "M_foo", "MT", "MT_foo", "Un", "Z"]
    assert one(spark, variants.genotype_index(F.array(lit(1), lit(2)), 2), variants.unphase(lit("1|0"))) == (4, "0/1")
    assert variants.genotypes(2, 2) == [[0, 0], [0, 1], [1, 1], [0, 2], [1, 2], [2, 2]]


def test_dedupe(spark):
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, ordinal long"
    rows = [("r1", 99, "ref", 1, 30, "2M", "=", 4, 5, "AA", "II", 0), ("r2", 99, "ref", 1, 30, "2M", "=", 4, 5, "AA", "IJ", 1), ("r1", 147, "ref", 4, 30, "2M", "=", 1, -5, "AA", "II", 2), ("r2", 147, "ref", 4, 30, "2M", "=", 1, -5, "AA", "II", 3)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.ordinal for r in A.dedupe(df).collect()) == [1, 3]
    assert sorted((r.ordinal, r.flag) for r in A.dedupe(df, remove=False).collect()) == [(0, 1123), (1, 99), (2, 1171), (3, 147)]


def test_overlap_correction(spark):
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, ordinal long"
    rows = [("R001", 99, "ref", 3, 20, "8M", "=", 3, 8, "AACCGGTT", "AABBCCDD", 0), ("R001", 147, "ref", 3, 20, "8M", "=", 3, -8, "AACCGGTT", "AABBCCz~", 1)]
    got = sorted((r.pos, r.qual) for r in pileup.pileup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(3, 64), (4, 64), (5, 66), (6, 66), (7, 68), (8, 68), (9, 35 + 89), (10, 35 + 93)]


def test_realign_and_split(spark):
    ref = spark.createDataFrame([("r", "GGGCACACACAGGG")], "name string, sequence string")
    v = spark.createDataFrame([(1, "r", 8, "CAC", ["C"]), (2, "r", 10, "CA", ["CG", "C"]), (3, "r", 4, "C", ["<DEL>"]), (4, "r", 2, "GG", None)], "id int, chr string, pos int, ref string, alt array<string>")
    got = {r.id: (r.pos, r.ref, r.alt) for r in V.realign(v, ref).collect()}
    assert got[1] == (3, "GCA", ["G"]) and got[3] == (4, "C", ["<DEL>"]) and got[4] == (2, "G", None)
    s = V.split(spark.createDataFrame([(1, ["A", "C"], "0/2", [5, 6], [1, 2, 3])], "id int, alt array<string>, gt string, a array<int>, r array<int>"), {"a": "A", "r": "R"}).orderBy("alt_index").collect()
    assert [(x.alt, x.gt, x.a, x.r) for x in s] == [(["A"], "0/0", [5], [1, 2]), (["C"], "0/1", [6], [1, 3])]


def test_realign_through_long_repeats(spark):
    ref = spark.createDataFrame([("r", "GGG" + "CA" * 2000 + "GGG")], "name string, sequence string")
    v = spark.createDataFrame([(1, "r", 4000, "CAC", ["C"]), (2, "r", 3000, "CAC", ["C"]), (3, "r", 8, "CAC", ["C"])], "id int, chr string, pos int, ref string, alt array<string>")
    assert sorted((r.id, r.pos, r.ref, r.alt) for r in V.realign(v, ref, window=10).collect()) == [(i, 3, "GCA", ["G"]) for i in (1, 2, 3)]


def test_catalogue_without_llm():
    import __spark_entry__ as e

    assert {"depth_sparse", "bed_subtract", "level"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_numbers_of_rows_that_come_in_another_order_each_time(spark):
    from strandwise.sources import text

    def anyhow(batches):
        for b in batches:
            yield b.take(pa.array(np.random.default_rng().permutation(b.num_rows)))

    # ranges are cut by a sample of rows, which come in any order out of a shuffle
    rows = spark.range(200_000, numPartitions=8).select("id", (F.col("id") * 7919 % 200_003).alias("ordinal")).mapInArrow(anyhow, "id long, ordinal long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = text.in_file_order(rows).agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.sum("id")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(out) == (200_000, 200_000, 0, 199_999, 200_000 * 199_999 // 2)


def test_read_names_by_one_match(spark):
    names = ["M1:2:FC:1:30:4:7 2:N:0:ACGT", "@M1:2:FC:1:30:4:7 1:Y:18:", "HWI:6:73:941:1973#0/1", "HWI:6:73:941:1973", "plain", "a\nb", None]
    p = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").select("i", sequences.parse_read_name(F.col("name")).alias("p"))
    got = {r.i: r.p and tuple(r.p) for r in p.collect()}
    assert got[0] == ("1.8", "M1", "2", "FC", "1", "30", "4", "7", "2", "N", "0", "ACGT")
    assert got[1] == ("1.8", "M1", "2", "FC", "1", "30", "4", "7", "1", "Y", "18", None)
    assert got[2] == ("1.0", "HWI", None, None, "6", "73", "941", "1973", "1", None, None, "0")
    assert got[3] == ("1.0", "HWI", None, None, "6", "73", "941", "1973", None, None, None, None)
    assert got[4] is got[5] is got[6] is None
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(f) for f in ("regexp_extract", "regexp_replace", "RLIKE")) == 2  # one for each naming scheme


def test_subtract_leaves_the_left_side_where_it_is(spark):
    rng = np.random.default_rng(3)
    rows = lambda n, width: [(f"c{c}" if c else None, int(s), int(s + w)) for c, s, w in zip(rng.integers(0, 4, n), rng.integers(1, 3000, n), rng.integers(-1, width, n))]
    left = frame(spark, [(*r, i) for i, r in enumerate(rows(400, 300))] + [("c1", None, 5, 400), ("other", 1, 9, 401)], ", id long")
    right = frame(spark, rows(60, 40)).where("start <= end")
    few = I.subtract(left, right)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    most, I.EVERYWHERE = I.EVERYWHERE, 0
    try:
        many = I.subtract(left, right)
        key = lambda r: tuple((x is None, x) for x in r)
        assert few.columns == many.columns and few.schema.simpleString() == many.schema.simpleString()
        a, b = (sorted((tuple(r) for r in x.collect()), key=key) for x in (few, many))
    finally:
        I.EVERYWHERE = most
    assert a == b and len(a) > 400
