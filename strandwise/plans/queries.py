"""Catalogue of queries over the driver's tables, with DuckDB SQL written apart from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar, flags, regions, sequences, tags, variants
from ..operators import alignments as A
from ..operators import coverage, intervals, pileup
from ..operators import variants as V
from ..storage import numbered
from ..streaming import sessions
from . import derive

QUERIES = {}
ORACLES = {}

I, O, L, VR, RF = (derive.duck(x) for x in (derive.INTERVALS, derive.OTHERS, derive.ALIGNMENTS, derive.VARIANTS, derive.REFS))  # noqa: E741


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _simple(name, source, columns, sql):
    """A query that selects expressions from a derived relation."""
    query(name, sql)(lambda spark, d: source(spark, d).select(*columns()))


# --- scalar expressions over alignments

REFLEN = "list_sum(list_transform(regexp_extract_all(cigar, '\\d+[MDN=X]'), lambda x: left(x, len(x) - 1)::INT))"
QLEN = "list_sum(list_transform(regexp_extract_all(cigar, '\\d+[MIS=X]'), lambda x: left(x, len(x) - 1)::INT))"
c = F.col
_simple("cigar_ref_len", derive.alignments, lambda: ["ordinal", cigar.reference_length(c("cigar")).alias("n")], f"SELECT ordinal, coalesce({REFLEN}, 0)::INT AS n FROM {L}")
_simple("cigar_query_len", derive.alignments, lambda: ["ordinal", cigar.query_length(c("cigar")).alias("n")], f"SELECT ordinal, coalesce({QLEN}, 0)::INT AS n FROM {L}")
_simple("cigar_end", derive.alignments, lambda: ["ordinal", cigar.end(c("pos"), c("cigar")).alias("last")], f"SELECT ordinal, (pos + greatest(coalesce({REFLEN}, 0) - 1, 0))::INT AS last FROM {L}")
_simple("cigar_op_count", derive.alignments, lambda: ["ordinal", cigar.count_ops(c("cigar")).alias("n")], f"SELECT ordinal, len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'))::INT AS n FROM {L}")
_simple(
    "cigar_simplify",
    derive.alignments,
    lambda: ["ordinal", cigar.simplify(F.concat("cigar", F.lit("2M"), F.lit("3M1S"))).alias("cigar")],
    f"SELECT ordinal, CASE WHEN cigar = '*' THEN '5M1S' ELSE CASE WHEN cigar LIKE '%M' THEN regexp_replace(cigar, '\\d+M$', '') || (regexp_extract(cigar, '(\\d+)M$', 1)::INT + 5) || 'M1S' ELSE cigar || '5M1S' END END AS cigar FROM {L}",
)
_simple(
    "cigar_encode",
    derive.alignments,
    lambda: ["ordinal", F.array_join(F.transform(cigar.encode(c("cigar")), lambda x: x.cast("string")), ",").alias("encoded"), cigar.decode(cigar.encode(c("cigar"))).alias("decoded")],
    f"SELECT ordinal, coalesce(array_to_string(list_transform(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'), lambda x: (left(x, len(x) - 1)::BIGINT * 16 + instr('MIDNSHP=X', right(x, 1)) - 1)::VARCHAR), ','), '') AS encoded, CASE WHEN cigar = '*' THEN '' ELSE cigar END AS decoded FROM {L}",
)
_simple("read_filter", derive.alignments, lambda: ["ordinal", flags.pile_filter(c("flag"), c("cigar"), c("mapq"), 5).alias("taken")], f"SELECT ordinal, ((flag & 3844) = 0 AND ((flag & 1) = 0 OR (flag & 2) <> 0) AND cigar <> '' AND mapq >= 5) AS taken FROM {L}")
_FLAGS = " || ".join(f"CASE WHEN flag & {b} <> 0 THEN ',{n}' ELSE '' END" for b, n in flags.NAMES.items())
_simple("flag_decode", derive.alignments, lambda: ["ordinal", F.array_join(flags.decode(c("flag")), ",").alias("names"), flags.encode(flags.decode(c("flag"))).alias("flag")], f"SELECT ordinal, ltrim({_FLAGS}, ',') AS names, flag::INT AS flag FROM {L}")
_simple(
    "flag_tests",
    derive.alignments,
    lambda: ["ordinal", *[f(c("flag")).alias(f.__name__.strip("_")) for f in (flags.primary, flags.multiple, flags.properly_aligned, flags.unmapped, flags.both_unmapped, flags.reversed_, flags.r1, flags.r2, flags.secondary)]],
    f"SELECT ordinal, flag & 2304 = 0 AS \"primary\", flag & 1 <> 0 AS multiple, flag & 2 <> 0 AS properly_aligned, flag & 4 <> 0 AS unmapped, flag & 12 = 12 AS both_unmapped, flag & 16 <> 0 AS reversed, flag & 64 <> 0 AS r1, flag & 128 <> 0 AS r2, flag & 256 <> 0 AS secondary FROM {L}",
)
query("r1r2_counts", f"SELECT ((flag >> 6) & 3)::INT AS which, count(*) AS n FROM {L} GROUP BY 1")(lambda s, d: derive.alignments(s, d).groupBy(flags.r1r2(c("flag")).alias("which")).agg(F.count("*").alias("n")))
_simple("revcomp", derive.alignments, lambda: ["ordinal", sequences.revcomp(F.concat("seq", F.lit("acgtnXz"))).alias("s")], f"SELECT ordinal, translate(reverse(regexp_replace(seq || 'acgtnXz', '[^ATGCNatgcn]', 'N', 'g')), 'ATGCatgc', 'TACGtacg') AS s FROM {L}")
_simple("base_recode", derive.alignments, lambda: ["ordinal", sequences.recode(F.concat("seq", F.lit("nN"))).alias("s")], f"SELECT ordinal, translate(seq || 'nN', 'ACGTNacgtn', '1234512345') AS s FROM {L}")
_simple("normalize_bases", derive.alignments, lambda: ["ordinal", sequences.normalize_bases(F.concat(F.lower("seq"), F.lit(".n"))).alias("s")], f"SELECT ordinal, upper(replace(lower(seq) || '.n', '.', 'N')) AS s FROM {L}")
_simple("phred_decode", derive.alignments, lambda: ["ordinal", F.array_join(F.transform(sequences.phred_decode(c("qual")), lambda x: x.cast("string")), ",").alias("q")], f"SELECT ordinal, array_to_string(list_transform(string_split(qual, ''), lambda x: (ascii(x) - 33)::VARCHAR), ',') AS q FROM {L}")
_simple("phred_encode", derive.alignments, lambda: ["ordinal", sequences.phred_encode(F.array(c("mapq"), c("mapq") + 40, F.lit(-3))).alias("q")], f"SELECT ordinal, chr((least(mapq, 93) + 33)::INT) || chr((least(mapq + 40, 93) + 33)::INT) || '!' AS q FROM {L}")
_simple("sum_quals", derive.alignments, lambda: ["ordinal", sequences.quality_sum(c("qual")).alias("n")], f"SELECT ordinal, list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33))::INT AS n FROM {L}")
_simple(
    "sam_to_fastq",
    lambda s, d: A.to_reads(derive.alignments(s, d)),
    lambda: ["name", "sequence", "quality", "which"],
    f"SELECT CASE WHEN (flag >> 6) & 3 IN (1, 2) THEN qname || '/' || ((flag >> 6) & 3) ELSE qname END AS name, CASE WHEN flag & 16 <> 0 THEN translate(reverse(seq), 'ATGC', 'TACG') ELSE seq END AS sequence, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS quality, CASE WHEN (flag >> 6) & 3 IN (1, 2) THEN (flag >> 6) & 3 ELSE 0 END::INT AS which FROM {L} WHERE flag & 2304 = 0",
)
NAME = "concat('M', CAST(l_suppkey AS STRING), ':', CAST(l_linenumber AS STRING), ':FC:1:', CAST(l_partkey AS STRING), ':', CAST(l_orderkey AS STRING), ':7 ', CAST(l_linenumber % 2 + 1 AS STRING), ':N:0:ACGT')"


@query("fastq_name_casava", f"SELECT '1.8' AS version, 'M' || l_suppkey AS instrument, l_partkey::VARCHAR AS tile, l_orderkey::VARCHAR AS x, (l_linenumber % 2 + 1)::VARCHAR AS pair, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    names = derive.relation(spark, d, f"SELECT {NAME} AS name FROM lineitem")
    p = names.select(sequences.parse_read_name(c("name")).alias("p"))
    return p.select(*[f"p.{k}" for k in ("version", "instrument", "tile", "x", "pair")]).groupBy("version", "instrument", "tile", "x", "pair").agg(F.count("*").alias("n"))


# --- regions, chromosomes and bins

REGIONS = "SELECT concat('chr', CAST(l_suppkey AS STRING), CASE WHEN l_linenumber > 1 THEN concat(':', CAST(l_partkey AS STRING)) ELSE '' END, CASE WHEN l_linenumber > 2 THEN concat('-', CAST(l_partkey + 50 AS STRING)) ELSE '' END) AS r, l_orderkey * 8 + l_linenumber AS id, l_suppkey, l_partkey, l_linenumber FROM lineitem"


@query("region_parse", f"SELECT id, 'chr' || l_suppkey AS chr, CASE WHEN l_linenumber > 1 THEN l_partkey END AS s, CASE WHEN l_linenumber > 2 THEN l_partkey + 50 END AS e, (l_linenumber > 2 AND l_partkey >= 1) AS strict FROM {derive.duck(REGIONS)}")
def _(spark, d):
    r = regions.parse_region(c("r"))
    return derive.relation(spark, d, REGIONS).select("id", r["chr"].alias("chr"), r["start"].alias("s"), r["end"].alias("e"), regions.parse_region_strict(c("r")).isNotNull().alias("strict"))


query("region_format", f"SELECT id, r FROM {derive.duck(REGIONS)}")(lambda s, d: derive.relation(s, d, REGIONS).select("id", regions.format_region(F.concat(F.lit("chr"), c("l_suppkey").cast("string")), F.when(c("l_linenumber") > 1, c("l_partkey")), F.when(c("l_linenumber") > 2, c("l_partkey") + 50)).alias("r")))
_simple("region_valid", derive.intervals, lambda: ["id", regions.valid_region(c("chr"), c("start") - 20, c("end") - 40).alias("ok")], f"SELECT id, (pos_s - 20 >= 1 AND pos_e - 40 >= 1 AND pos_s - 20 <= pos_e - 40) AS ok FROM {I}")
CHROMS = "SELECT CASE l_partkey % 8 WHEN 0 THEN concat('chr', CAST(l_suppkey + 1 AS STRING)) WHEN 1 THEN CAST(l_suppkey + 1 AS STRING) WHEN 2 THEN 'x' WHEN 3 THEN 'MT' WHEN 4 THEN 'chrUn_x' WHEN 5 THEN 'Chr0007' WHEN 6 THEN 'M_foo' ELSE 'GL1' END AS name, l_suppkey + 1 AS k, l_partkey % 8 AS kind, l_orderkey * 8 + l_linenumber AS id FROM lineitem"
query("chrom_normalize", f"SELECT id, CASE kind WHEN 0 THEN name WHEN 1 THEN 'chr' || name WHEN 2 THEN 'chrX' WHEN 3 THEN 'chrM' WHEN 4 THEN name WHEN 5 THEN 'chr7' WHEN 6 THEN 'chrM_foo' ELSE name END AS norm, kind IN (2, 3, 5) OR (kind < 2 AND k <= 22) AS main FROM {derive.duck(CHROMS)}")(
    lambda s, d: derive.relation(s, d, CHROMS).select("id", regions.normalize_chromosome(c("name")).alias("norm"), regions.is_primary_chromosome(c("name")).alias("main"))
)
query("chrom_order", f"SELECT id, CASE kind WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN 2147483643 WHEN 3 THEN 2147483646 WHEN 4 THEN 2147483647 WHEN 5 THEN 2147483647 WHEN 6 THEN 2147483645 ELSE 2147483647 END::BIGINT AS number, CASE kind WHEN 4 THEN 'chrUn_x' WHEN 5 THEN 'Chr0007' WHEN 6 THEN '_foo' WHEN 7 THEN 'GL1' ELSE '' END AS suffix FROM {derive.duck(CHROMS)}")(
    lambda s, d: derive.relation(s, d, CHROMS).select("id", regions.chromosome_order(c("name"))["number"].alias("number"), regions.chromosome_order(c("name"))["suffix"].alias("suffix"))
)
_BIN = "CASE " + " ".join(f"WHEN (pos_s - 1) >> {14 + 3 * (5 - k)} = (pos_e - 1) >> {14 + 3 * (5 - k)} THEN {(8**k - 1) // 7} + ((pos_s - 1) >> {14 + 3 * (5 - k)})" for k in (5, 4, 3, 2, 1)) + " ELSE 0 END"
_simple("ucsc_bin", derive.intervals, lambda: ["id", regions.region_bin(c("start"), c("end")).alias("bin"), regions.bin_level(regions.region_bin(c("start"), c("end"))).alias("level"), regions.linear_offset(c("start")).alias("window")], f"SELECT id, bin::BIGINT AS bin, CASE WHEN bin >= 4681 THEN 5 WHEN bin >= 585 THEN 4 WHEN bin >= 73 THEN 3 WHEN bin >= 9 THEN 2 WHEN bin >= 1 THEN 1 ELSE 0 END::INT AS level, (pos_s - 1) >> 14 AS \"window\" FROM (SELECT *, {_BIN} AS bin FROM {I})")
_simple("ucsc_bins", derive.intervals, lambda: ["id", F.explode(regions.region_bins(c("start"), c("end"))).alias("bin")], " UNION ALL ".join(f"SELECT id, unnest(range((({(8**k - 1) // 7}) + ((pos_s - 1) >> {14 + 3 * (5 - k)}))::BIGINT, (({(8**k - 1) // 7}) + ((pos_e - 1) >> {14 + 3 * (5 - k)}) + 1)::BIGINT)) AS bin FROM {I}" for k in range(6)))

# --- tags

TAGS = "SELECT l_orderkey * 8 + l_linenumber AS id, concat('NM:i:', CAST(l_linenumber AS STRING), ' MD:Z:', CAST(l_linenumber AS STRING), 'A3^CG', CAST(l_partkey AS STRING), ' SA:Z:chr', CAST(l_suppkey AS STRING), ',', CAST(l_partkey AS STRING), ',+,5M3S,60,1;chr2,9,-,8M,7,0; XA:Z:chr3,-', CAST(l_partkey AS STRING), ',8M,2;') AS t, l_linenumber, l_partkey, l_suppkey FROM lineitem"


def _tagged(spark, d):
    return derive.relation(spark, d, TAGS).withColumn("tags", tags.parse(F.split("t", " ")))


query("tag_parse", f"SELECT id, l_linenumber::INT AS nm, 'i' AS kind, l_linenumber || 'A3^CG' || l_partkey AS md FROM {derive.duck(TAGS)}")(lambda s, d: _tagged(s, d).select("id", tags.value(c("tags"), "NM").cast("int").alias("nm"), c("tags")[0]["type"].alias("kind"), tags.value(c("tags"), "MD").alias("md")))
query("tag_md", f"SELECT id, unnest(['match', 'mismatch', 'match', 'deletion', 'match']) AS kind, unnest([l_linenumber, 1, 3, 2, l_partkey])::INT AS n, unnest([NULL, 'A', NULL, 'CG', NULL]) AS bases FROM {derive.duck(TAGS)}")(lambda s, d: _tagged(s, d).select("id", F.explode(tags.parse_md(tags.value(c("tags"), "MD"))).alias("m")).select("id", "m.*"))
query("tag_sa", f"SELECT id, unnest(['chr' || l_suppkey, 'chr2']) AS rname, unnest([l_partkey, 9])::INT AS pos, unnest(['+', '-']) AS strand, unnest(['5M3S', '8M']) AS cigar, unnest([60, 7])::INT AS mapq, unnest([1, 0])::INT AS nm FROM {derive.duck(TAGS)}")(lambda s, d: _tagged(s, d).select("id", F.explode(tags.parse_sa(tags.value(c("tags"), "SA"))).alias("m")).select("id", "m.*"))
query("tag_xa", f"SELECT id, 'chr3' AS rname, '-' AS strand, l_partkey::INT AS pos, '8M' AS cigar, 2 AS nm FROM {derive.duck(TAGS)}")(lambda s, d: _tagged(s, d).select("id", F.explode(tags.parse_xa(tags.value(c("tags"), "XA"))).alias("m")).select("id", "m.*"))

# --- interval algebra

GAPS = "(SELECT *, CASE WHEN pos_s - 1 - max(pos_e) OVER (PARTITION BY chr ORDER BY pos_s, pos_e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS n FROM {rel})"


def merged_sql(rel: str, gap: int) -> str:
    return f"(SELECT chr, min(pos_s) AS pos_s, max(pos_e) AS pos_e, count(*) AS parts FROM (SELECT *, sum(n) OVER (PARTITION BY chr ORDER BY pos_s, pos_e ROWS UNBOUNDED PRECEDING) AS g FROM {GAPS.format(gap=gap, rel=rel)}) GROUP BY chr, g)"


for _gap in (0, 500):
    query(f"interval_merge_gap{_gap}", f'SELECT chr, pos_s AS "start", pos_e AS "end", parts FROM {merged_sql(I, _gap)}')(lambda s, d, g=_gap: intervals.merge(derive.intervals(s, d), g, F.count("*").alias("parts")))
query("bed_merge_names", f"SELECT chr, min(pos_s) AS \"start\", max(pos_e) AS \"end\", string_agg(chr || ':' || pos_s || '-' || pos_e, '+' ORDER BY pos_s, pos_e) AS name FROM (SELECT *, sum(n) OVER (PARTITION BY chr ORDER BY pos_s, pos_e ROWS UNBOUNDED PRECEDING) AS g FROM {GAPS.format(gap=0, rel=O)}) GROUP BY chr, g")(
    lambda s, d: intervals.merge_named(derive.others(s, d).withColumn("name", F.lit(None).cast("string")))
)
query("interval_overlap_join", f"SELECT a.id AS a, b.id AS b, a.chr, least(a.pos_e, b.pos_e) - greatest(a.pos_s, b.pos_s) + 1 AS n FROM {I} a JOIN {O} b ON a.chr = b.chr AND a.pos_s <= b.pos_e AND b.pos_s <= a.pos_e")(
    lambda s, d: intervals.overlap_join(derive.intervals(s, d), derive.others(s, d)).select(c("id").alias("a"), c("id_2").alias("b"), "chr", (F.least("end", "end_2") - F.greatest("start", "start_2") + 1).alias("n"))
)
query("interval_semi", f"SELECT id FROM {O} a WHERE EXISTS (SELECT 1 FROM {I} b WHERE a.chr = b.chr AND a.pos_s <= b.pos_e AND b.pos_s <= a.pos_e)")(lambda s, d: intervals.overlap_join(derive.others(s, d), derive.intervals(s, d), how="left_semi").select("id"))
query("interval_anti", f"SELECT id FROM {O} a WHERE NOT EXISTS (SELECT 1 FROM {I} b WHERE a.chr = b.chr AND a.pos_s <= b.pos_e AND b.pos_s <= a.pos_e)")(lambda s, d: intervals.overlap_join(derive.others(s, d), derive.intervals(s, d), how="left_anti").select("id"))
query("bed_intersect", f'SELECT a.id, a.chr, greatest(a.pos_s, b.pos_s) AS "start", least(a.pos_e, b.pos_e) AS "end" FROM {I} a JOIN {merged_sql(O, 0)} b ON a.chr = b.chr AND a.pos_s <= b.pos_e AND b.pos_s <= a.pos_e')(lambda s, d: intervals.intersect(derive.intervals(s, d), derive.others(s, d)).select("id", "chr", "start", "end"))
query(
    "bed_subtract",
    f"""WITH m AS {merged_sql(O, 0)}, g AS (SELECT chr, coalesce(lag(pos_e) OVER w, 0) + 1 AS pos_s, pos_s - 1 AS pos_e FROM m WINDOW w AS (PARTITION BY chr ORDER BY pos_s) UNION ALL SELECT chr, max(pos_e) + 1, 99999999 FROM m GROUP BY chr)
SELECT a.id, a.chr, greatest(a.pos_s, g.pos_s) AS "start", least(a.pos_e, g.pos_e) AS "end" FROM {I} a JOIN g ON a.chr = g.chr AND a.pos_s <= g.pos_e AND g.pos_s <= a.pos_e
UNION ALL SELECT id, chr, pos_s, pos_e FROM {I} WHERE chr NOT IN (SELECT chr FROM m)""",
)(lambda s, d: intervals.subtract(derive.intervals(s, d), derive.others(s, d)).select("id", "chr", "start", "end"))
query("bed_complement", f"WITH m AS {merged_sql(I, 0)}, r AS {RF} SELECT chr, \"start\", \"end\" FROM (SELECT chr, coalesce(lag(pos_e) OVER (PARTITION BY chr ORDER BY pos_s), 0) + 1 AS \"start\", pos_s - 1 AS \"end\" FROM m UNION ALL SELECT name, coalesce(max(pos_e), 0) + 1, 1000000 FROM r LEFT JOIN m ON m.chr = r.name GROUP BY name) WHERE \"start\" <= \"end\"")(
    lambda s, d: intervals.complement(derive.intervals(s, d), derive.refs(s, d))
)
query("subtract_pair", f"SELECT id, unnest(list_filter([{{'s': pos_s, 'e': least(pos_e, pos_s + 19)}}, {{'s': pos_s + 31, 'e': pos_e}}], lambda p: p.s <= p.e), recursive := true) FROM {I}")(lambda s, d: derive.intervals(s, d).select("id", F.explode(regions.subtract_region(c("start"), c("end"), c("start") + 20, c("start") + 30)).alias("p")).select("id", c("p.start").alias("s"), c("p.end").alias("e")))
query("divide_refs", f"SELECT name AS chr, s AS \"start\", least(s + 69999, len) AS \"end\" FROM (SELECT *, unnest(range(1, len + 1, 70000)) AS s FROM {RF})")(lambda s, d: intervals.divide(derive.refs(s, d), 70000))
query("region_overlap", f"SELECT id FROM {I} WHERE chr = 'chr2' AND pos_e >= 2000 AND pos_s <= 5000")(lambda s, d: intervals.in_region(derive.intervals(s, d), "chr2", 2000, 5000).select("id"))
query("region_within", f"SELECT id FROM {I} WHERE chr = 'chr2' AND pos_s >= 2000 AND pos_e <= 5000")(lambda s, d: intervals.in_region(derive.intervals(s, d), "chr2", 2000, 5000, within=True).select("id"))

# --- coordinates and orders

OFFSETS = f"(SELECT name, len, idx, coalesce(sum(len) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM {RF})"
query("genome_coord", f"SELECT id, o + pos_s AS genome_pos FROM {I} JOIN {OFFSETS} ON chr = name")(lambda s, d: A.to_genome(derive.intervals(s, d), derive.refs(s, d)).select("id", "genome_pos"))
query("genome_to_chr", f"SELECT id, chr, pos_s AS \"start\" FROM {I}")(lambda s, d: A.from_genome(A.to_genome(derive.intervals(s, d), derive.refs(s, d)).select("id", "genome_pos"), derive.refs(s, d)).select("id", "chr", "start"))
query("genome_regions", f"SELECT id, name AS chr, greatest(g, o + 1) - o AS \"start\", least(g + 1500000, o + len) - o AS \"end\" FROM (SELECT o_orderkey AS id, o_orderkey * 17 % 20000000 + 1 AS g FROM orders) JOIN {OFFSETS} ON g <= o + len AND g + 1500000 > o")(
    lambda s, d: A.genome_regions(derive.relation(s, d, "SELECT o_orderkey AS id, o_orderkey * 17 % 20000000 + 1 AS gstart, o_orderkey * 17 % 20000000 + 1500001 AS gend FROM orders"), derive.refs(s, d)).select("id", "chr", "start", "end")
)


def _numbered(df):
    """(ordinal, rank) of a sorted frame."""
    return numbered(df.select("ordinal"), "rank")


query("sort_pos_rank", f"SELECT ordinal, row_number() OVER (ORDER BY idx NULLS LAST, pos, (flag >> 4) & 1, ordinal) AS rank FROM {L} LEFT JOIN {RF} ON rname = name")(lambda s, d: _numbered(A.sort_by_position(derive.alignments(s, d), derive.refs(s, d))))
query("sort_qname_rank", f"SELECT ordinal, row_number() OVER (ORDER BY qname, (flag >> 6) & 3, ordinal) AS rank FROM {L}")(lambda s, d: _numbered(A.sort_by_name(derive.alignments(s, d))))
query("bed_sort_rank", f"SELECT id AS ordinal, row_number() OVER (ORDER BY substr(chr, 4)::INT, pos_s, pos_e) AS rank FROM (SELECT chr, pos_s, max(pos_e) AS pos_e, min(id) AS id FROM {I} GROUP BY chr, pos_s)")(
    lambda s, d: _numbered(A.sort_features(derive.intervals(s, d).groupBy("chr", "start").agg(F.max("end").alias("end"), F.min("id").alias("ordinal"))))
)

# --- coverage and pileups

ENDS = f"(SELECT *, pos + greatest(coalesce({REFLEN}, 0) - 1, 0) AS last FROM {L})"


def _spans(spark, d):
    return derive.alignments(spark, d).withColumn("end", cigar.end(c("pos"), c("cigar")))


STEPS = f"(SELECT rname, pos, sum(d) AS d FROM (SELECT rname, pos, 1 AS d FROM {ENDS} WHERE pos > 0 UNION ALL SELECT rname, last + 1, -1 FROM {ENDS} WHERE pos > 0) GROUP BY rname, pos)"
query(
    "depth_sparse",
    f"WITH x AS (SELECT rname, pos, lead(pos) OVER w - 1 AS e, sum(d) OVER (PARTITION BY rname ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM {STEPS} WHERE d <> 0 WINDOW w AS (PARTITION BY rname ORDER BY pos)) SELECT rname, pos::BIGINT AS \"start\", e::BIGINT AS \"end\", depth::BIGINT AS depth FROM x WHERE depth > 0",
)(lambda s, d: coverage.depth_runs(_spans(s, d)))
for _name, _s, _e in (("depth_region", 1000, 3000), ("depth_dense", 1, 160000)):
    query(_name, f"SELECT p AS pos, coalesce(n, 0)::BIGINT AS depth FROM (SELECT unnest(range({_s}, {_e + 1})) AS p) LEFT JOIN (SELECT unnest(range(pos::BIGINT, (last + 1)::BIGINT)) AS q, count(*) AS n FROM {ENDS} WHERE rname = 'chr3' GROUP BY 1) ON p = q")(lambda s, d, a=_s, b=_e: coverage.depth(_spans(s, d), "chr3", a, b, derive.LENGTH))

# plain aligned bases of a read, in SQL: (kind, reference offset, query offset) by CIGAR shape
SHAPES = {
    "10M": [("m", i, i) for i in range(10)],
    "3S7M": [("m", i, i + 3) for i in range(7)],
    "4M2I4M": [("m", i, i) for i in range(4)] + [("m", i, i + 2) for i in range(4, 8)],
    "5M3D5M": [("m", i, i) for i in range(5)] + [("d", i, -1) for i in range(5, 8)] + [("m", i, i - 3) for i in range(8, 13)],
    "4M20N6M": [("m", i, i) for i in range(4)] + [("n", i, -1) for i in range(4, 24)] + [("m", i, i - 20) for i in range(24, 30)],
    "2H8M": [("m", i, i) for i in range(8)],
}
SHAPE_ROWS = "(VALUES " + ", ".join(f"('{s}', '{k}', {r}, {q})" for s, rows in SHAPES.items() for k, r, q in rows) + ") sh(shape, kind, r, q)"
PILES = f"""(SELECT l.*, l.pos + r AS p, kind, CASE kind WHEN 'm' THEN substr(seq, q + 1, 1) WHEN 'd' THEN '*' ELSE '>' END AS base, CASE kind WHEN 'm' THEN ascii(substr(qual, q + 1, 1)) - 33 ELSE 93 END AS bq
FROM {L} l JOIN {SHAPE_ROWS} ON l.cigar = shape WHERE (flag & 3844) = 0 AND ((flag & 1) = 0 OR (flag & 2) <> 0))"""
CORRECTED = f"""(SELECT *, CASE WHEN n = 2 AND rnext = '=' AND pn > 0 THEN CASE WHEN base = ob THEN CASE WHEN k = 1 THEN least(200, bq + oq) ELSE 0 END
  WHEN k = 1 AND bq >= oq THEN floor(bq * 0.8) WHEN k = 2 AND bq > oq THEN floor(bq * 0.8) ELSE 0 END ELSE bq END::INT AS fq
FROM (SELECT *, count(*) OVER (PARTITION BY rname, qname, p) AS n, row_number() OVER w AS k, coalesce(lag(base) OVER w, lead(base) OVER w) AS ob, coalesce(lag(bq) OVER w, lead(bq) OVER w) AS oq, coalesce(lag(pnext) OVER w, pnext) AS pn FROM {PILES} WINDOW w AS (PARTITION BY rname, qname, p ORDER BY ordinal)))"""


def _piles(spark, d, **options):
    return pileup.pileup(derive.alignments(spark, d), **options)


query("cigar_expand", f"SELECT rname, p::BIGINT AS pos, kind, count(*) AS n FROM {PILES} GROUP BY ALL")(lambda s, d: pileup.pile_rows(derive.alignments(s, d)).groupBy("rname", c("pos").cast("long").alias("pos"), F.when(c("base") == "*", "d").when(c("base") == ">", "n").otherwise("m").alias("kind")).agg(F.count("*").alias("n")))
query("pileup_counts", f"SELECT rname, p::BIGINT AS pos, count(*) AS n FROM {CORRECTED} WHERE fq >= 13 GROUP BY ALL")(lambda s, d: _piles(s, d, fields=("rname", "pos")).groupBy("rname", c("pos").cast("long").alias("pos")).agg(F.count("*").alias("n")))
query("pileup_overlap_qual", f"SELECT ordinal, p::BIGINT AS pos, fq AS qual FROM {CORRECTED} WHERE n = 2")(
    lambda s, d: pileup.pile_rows(derive.alignments(s, d), correct_overlaps=True, fields=("ordinal", "pos", "qual", "shared")).where("shared = 2").select("ordinal", c("pos").cast("long").alias("pos"), "qual")
)
query("pileup_ignore_overlaps", f"SELECT rname, p::BIGINT AS pos, sum(bq)::BIGINT AS q FROM {PILES} WHERE bq >= 13 GROUP BY ALL")(lambda s, d: _piles(s, d, ignore_overlaps=True, fields=("rname", "pos", "qual")).groupBy("rname", c("pos").cast("long").alias("pos")).agg(F.sum("qual").alias("q")))
query("pileup_base_freq", f"SELECT base, count(*) AS n, sum(fq)::BIGINT AS q FROM {CORRECTED} WHERE fq >= 20 AND mapq >= 10 GROUP BY base")(lambda s, d: pileup.pile_rows(derive.alignments(s, d), correct_overlaps=True, fields=("base", "qual", "mapq")).where("qual >= 20 AND mapq >= 10").groupBy("base").agg(F.count("*").alias("n"), F.sum("qual").alias("q")))
query(
    "pileup_indels",
    f"SELECT rname, (pos + CASE cigar WHEN '4M2I4M' THEN 3 ELSE 4 END)::BIGINT AS pos, CASE cigar WHEN '4M2I4M' THEN 'i' ELSE 'd' END AS indel, CASE cigar WHEN '4M2I4M' THEN substr(seq, 5, 2) END AS inserted, count(*) AS n FROM {L} WHERE cigar IN ('4M2I4M', '5M3D5M') AND (flag & 3844) = 0 AND ((flag & 1) = 0 OR (flag & 2) <> 0) GROUP BY ALL",
)(lambda s, d: pileup.pile_rows(derive.alignments(s, d)).where("indel IS NOT NULL").groupBy("rname", c("pos").cast("long").alias("pos"), "indel", "inserted").agg(F.count("*").alias("n")))
query("pileup_bases", f"SELECT rname, p::BIGINT AS pos, string_agg(base, '' ORDER BY ordinal) AS bases FROM {CORRECTED} WHERE fq >= 13 GROUP BY ALL")(
    lambda s, d: _piles(s, d, fields=("rname", "pos", "ordinal", "base")).groupBy("rname", c("pos").cast("long").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "base"))), lambda x: x["base"]), "").alias("bases"))
)
_CASED = "CASE WHEN flag & 16 <> 0 THEN lower({x}) ELSE upper({x}) END"
_INDEL = f"CASE WHEN cigar = '4M2I4M' AND p = pos + 3 THEN '+2' || {_CASED.format(x='substr(seq, 5, 2)')} WHEN cigar = '5M3D5M' AND p = pos + 4 THEN '-3' || {_CASED.format(x="'NNN'")} ELSE '' END"
_LAST = "CASE cigar WHEN '10M' THEN 9 WHEN '3S7M' THEN 6 WHEN '4M2I4M' THEN 7 WHEN '5M3D5M' THEN 12 WHEN '4M20N6M' THEN 29 ELSE 7 END"
WRITTEN = f"CASE WHEN p = pos THEN '^' || chr((least(mapq, 93) + 33)::INT) ELSE '' END || CASE WHEN base = '>' AND flag & 16 <> 0 THEN '<' WHEN base IN ('>', '*') THEN base ELSE {_CASED.format(x='base')} END || {_INDEL} || CASE WHEN p = pos + {_LAST} THEN '$' ELSE '' END"
query("pileup_text", f"SELECT rname, p::INT AS pos, 'N' AS ref, count(*)::INT AS count, string_agg({WRITTEN}, '' ORDER BY ordinal) AS bases, string_agg(chr((least(fq, 93) + 33)::INT), '' ORDER BY ordinal) AS quals FROM {CORRECTED} WHERE fq >= 13 GROUP BY rname, p")(lambda s, d: pileup.pileup_text(_piles(s, d, fields=pileup.TEXT)))
_SAMPLE = "count(*) FILTER (ordinal % 2 = {k}) AS {n}, coalesce(string_agg({w}, '' ORDER BY ordinal) FILTER (ordinal % 2 = {k}), '') AS {n}_bases"


@query("mpileup_two_samples", f"SELECT rname, p::BIGINT AS pos, {_SAMPLE.format(k=0, n='a', w=WRITTEN)}, {_SAMPLE.format(k=1, n='b', w=WRITTEN)} FROM {PILES} WHERE bq >= 13 GROUP BY rname, p")
def _(spark, d):
    piles = _piles(spark, d, ignore_overlaps=True, fields=pileup.TEXT)
    m = pileup.mpileup({"a": piles.where("ordinal % 2 = 0"), "b": piles.where("ordinal % 2 = 1")})
    return m.select("rname", c("pos").cast("long").alias("pos"), c("a_count").cast("long").alias("a"), c("b_count").cast("long").alias("b"), "a_bases", "b_bases")


# --- alignments

DEDUPE = f"""
h AS (SELECT *, CASE WHEN qual = '*' THEN -1 ELSE list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) END AS sq FROM {L} WHERE (flag & 1) <> 0 AND (flag & 12) <> 12 AND rnext = '=' AND rname <> '*' AND tlen > 0),
lo AS (SELECT a.rname, a.qname, a.ordinal, (SELECT min(CASE WHEN b.ordinal > a.ordinal THEN b.ordinal ELSE a.ordinal END) FROM h b WHERE b.rname = a.rname AND b.pos = a.pos AND b.tlen = a.tlen AND (b.sq, b.mapq, b.ordinal) > (a.sq, a.mapq, a.ordinal)) AS t FROM h a),
rel AS (SELECT rname, qname, min(t) AS t FROM lo WHERE t IS NOT NULL GROUP BY ALL),
tails AS (SELECT min(l.ordinal) AS ordinal FROM {L} l JOIN rel ON l.rname = rel.rname AND l.qname = rel.qname WHERE (flag & 1) <> 0 AND (flag & 12) <> 12 AND rnext = '=' AND tlen <= 0 AND l.ordinal > t GROUP BY l.rname, l.qname),
dup AS (SELECT ordinal FROM lo WHERE t IS NOT NULL UNION SELECT ordinal FROM tails)"""
query("dedupe_removed", f"WITH {DEDUPE} SELECT ordinal FROM {L} WHERE rname <> '*' AND ordinal NOT IN (SELECT ordinal FROM dup)")(lambda s, d: A.dedupe(derive.alignments(s, d)).select("ordinal"))
query("dedupe_marked", f"WITH {DEDUPE} SELECT ordinal, (flag | CASE WHEN ordinal IN (SELECT ordinal FROM dup) THEN 1024 ELSE 0 END)::INT AS flag FROM {L} WHERE rname <> '*'")(lambda s, d: A.dedupe(derive.alignments(s, d), remove=False).select("ordinal", "flag"))
MATES = f"SELECT a.ordinal AS a, b.ordinal AS b FROM {L} a JOIN {L} b ON a.qname = b.qname AND a.rname = b.rname AND a.rnext = '=' AND a.pnext = b.pos AND ((a.flag & 64 <> 0 AND b.flag & 128 <> 0) OR (a.flag & 128 <> 0 AND b.flag & 64 <> 0)) AND b.flag & 2304 = 0"
query("mate_lookup", MATES)(lambda s, d: A.mates(derive.alignments(s, d), derive.alignments(s, d)).select(c("ordinal").alias("a"), c("mate_ordinal").alias("b")))
query("make_pairs", f"SELECT qname, min(ordinal) AS first, max(ordinal) AS second FROM {L} WHERE flag & 1 <> 0 AND flag & 2304 = 0 GROUP BY qname HAVING count(*) = 2")(lambda s, d: A.make_pairs(derive.alignments(s, d)))
query("make_pairs_fetched", f"WITH r AS (SELECT * FROM {L} WHERE flag = 99), n AS (SELECT qname, count(*) AS n, min(ordinal) AS a, max(ordinal) AS b FROM r GROUP BY qname) SELECT qname, a AS first, b AS second FROM n WHERE n = 2 UNION ALL SELECT r.qname, least(r.ordinal, b.ordinal), greatest(r.ordinal, b.ordinal) FROM r JOIN n ON n.qname = r.qname AND n.n = 1 JOIN {L} b ON b.qname = r.qname AND b.flag = 147")(lambda s, d: A.make_pairs(derive.alignments(s, d).where("flag = 99"), derive.alignments(s, d)))
# read by read: the first row whose last read ends before this one begins
LEVELS = f"""WITH RECURSIVE r AS (SELECT ordinal, rname, pos, last, row_number() OVER (PARTITION BY rname ORDER BY pos, ordinal) AS k FROM {ENDS} WHERE pos > 0),
s AS (SELECT rname, 0::BIGINT AS k, []::BIGINT[] AS ends, NULL::BIGINT AS ordinal, NULL::INT AS level FROM (SELECT DISTINCT rname FROM r) UNION ALL
  SELECT rname, k, CASE WHEN j = 0 THEN list_append(ends, last::BIGINT) ELSE list_concat(list_concat(ends[1 : j - 1], [last::BIGINT]), ends[j + 1 :]) END, ordinal, (CASE WHEN j = 0 THEN len(ends) ELSE j - 1 END)::INT
  FROM (SELECT r.*, s.ends, coalesce(list_position(list_transform(s.ends, lambda e: e < r.pos), true), 0) AS j FROM s JOIN r ON r.rname = s.rname AND r.k = s.k + 1))
SELECT ordinal, level FROM s WHERE k > 0 UNION ALL SELECT ordinal, NULL FROM {L} WHERE pos <= 0"""
query("level", LEVELS)(lambda s, d: A.add_levels(derive.alignments(s, d)).select("ordinal", "level"))
query("level_max", f"SELECT rname, max(n)::INT AS levels FROM (SELECT rname, sum(d) OVER (PARTITION BY rname ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM {STEPS}) GROUP BY rname")(lambda s, d: A.add_levels(derive.alignments(s, d)).where("level IS NOT NULL").groupBy("rname").agg((F.max("level") + 1).alias("levels")))
query("normalize_refs", f"SELECT ordinal, CASE WHEN rname = '*' THEN '*' ELSE rname END AS rname, rnext FROM {L}")(lambda s, d: A.normalize_references(derive.alignments(s, d).withColumn("rname", F.regexp_replace("rname", "^chr", ""))).select("ordinal", "rname", "rnext"))
query(
    "validate_alignments",
    f"SELECT ordinal, CASE WHEN mapq - 30 < 0 THEN 'mapq,' ELSE '' END || CASE WHEN len(qual) <> len(seq) THEN 'qual,' ELSE '' END || CASE WHEN cigar <> '*' AND {QLEN} <> len(seq) THEN 'cigar,' ELSE '' END AS paths FROM (SELECT * REPLACE (CASE WHEN ordinal % 7 = 0 THEN seq || 'A' ELSE seq END AS seq) FROM {L})",
)(lambda s, d: A.validate(derive.alignments(s, d).withColumn("mapq", c("mapq") - 30).withColumn("seq", F.when(c("ordinal") % 7 == 0, F.concat("seq", F.lit("A"))).otherwise(c("seq")))).select("ordinal", F.concat(F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(","))), "")).alias("paths")))
query("bai_like_stats", f"SELECT rname, count(*) FILTER (flag & 4 = 0) AS aligned, count(*) FILTER (flag & 4 <> 0) AS unaligned, min(pos)::INT AS first, max(pos)::INT AS last FROM {L} GROUP BY rname")(
    lambda s, d: derive.alignments(s, d).groupBy("rname").agg(F.count_if(~flags.unmapped(c("flag"))).alias("aligned"), F.count_if(flags.unmapped(c("flag"))).alias("unaligned"), F.min("pos").alias("first"), F.max("pos").alias("last"))
)
query("index_bins", f"SELECT rname, ({_BIN.replace('pos_s', 'pos').replace('pos_e', 'last')})::BIGINT AS bin, count(*) AS n FROM {ENDS} WHERE pos > 0 GROUP BY ALL")(lambda s, d: _spans(s, d).where("pos > 0").groupBy("rname", regions.region_bin(c("pos"), c("end")).alias("bin")).agg(F.count("*").alias("n")))

# --- variants

_simple("info_parse", derive.variants, lambda: ["id", variants.parse_info(c("info"))["DP"][0].cast("int").alias("dp"), F.map_contains_key(variants.parse_info(c("info")), "DB").alias("db"), variants.format_info(variants.parse_info(c("info"))).alias("text")], f"SELECT id, regexp_extract(info, 'DP=(\\d+)', 1)::INT AS dp, info LIKE '%DB' AS db, regexp_extract(info, 'AF=[^;]*', 0) || CASE WHEN info LIKE '%DB' THEN ';DB' ELSE '' END || ';' || regexp_extract(info, 'DP=[^;]*', 0) AS text FROM (SELECT id, info FROM {VR})")
ORDERED = f"SELECT id, CASE WHEN info LIKE '%DB' THEN regexp_extract(info, 'AF=[^;]*', 0) || ';DB;' || regexp_extract(info, 'DP=[^;]*', 0) ELSE regexp_extract(info, 'AF=[^;]*', 0) || ';' || regexp_extract(info, 'DP=[^;]*', 0) END AS text FROM {VR}"
_simple("format_zip", derive.variants, lambda: ["id", variants.format_sample(F.array(F.lit("GT"), F.lit("DP"), F.lit("AD")), variants.parse_sample(F.array(F.lit("GT"), F.lit("DP"), F.lit("AD")), F.concat("gt", F.lit(":"), F.when(c("id") % 2 == 0, ".").otherwise("7"), F.lit(":.,.")))).alias("s")], f"SELECT id, gt || CASE WHEN id % 2 = 0 THEN '' ELSE ':7' END AS s FROM {VR}")
_simple("gt_parse", derive.variants, lambda: ["id", variants.parse_genotype(c("gt"))[0]["allele"].alias("a"), variants.parse_genotype(c("gt"))[1]["allele"].alias("b"), variants.parse_genotype(c("gt"))[1]["phased"].alias("phased"), variants.format_genotype(variants.parse_genotype(c("gt"))).alias("gt")], f"SELECT id, TRY_CAST(left(gt, 1) AS INT) AS a, TRY_CAST(right(gt, 1) AS INT) AS b, gt LIKE '%|%' AS phased, gt FROM {VR}")
_simple("gt_unphase", derive.variants, lambda: ["id", variants.unphase(c("gt")).alias("gt")], f"SELECT id, CASE gt WHEN '1|0' THEN '0/1' WHEN '0|0' THEN '0/0' WHEN '1/.' THEN './1' ELSE gt END AS gt FROM {VR}")
_simple("gt_biallelic", derive.variants, lambda: ["id", variants.biallelic_genotype(F.translate("gt", "1", "2"), F.lit(2)).alias("a"), variants.biallelic_genotype(F.translate("gt", "1", "2"), F.lit(1)).alias("b")], f"SELECT id, gt AS a, replace(gt, '1', '0') AS b FROM {VR}")
_simple("gt_index", derive.variants, lambda: ["id", variants.genotype_index(F.array((c("id") % 4).cast("int"), (c("id") % 3).cast("int")), 2).alias("i")], f"SELECT id, (greatest(id % 4, id % 3) * (greatest(id % 4, id % 3) + 1) // 2 + least(id % 4, id % 3))::INT AS i FROM {VR}")
ONE = f"(SELECT id, ref, unnest(string_split(alt, ',')) AS a FROM {VR})"
KIND = "CASE WHEN a = '.' THEN 'no-call' WHEN a = '*' THEN 'spanning-deletion' WHEN a LIKE '<%' THEN 'id' WHEN a LIKE '%[%' THEN 'breakend' WHEN ref = a THEN 'ref' WHEN len(ref) = 1 AND len(a) = 1 THEN 'snv' WHEN len(ref) = len(a) THEN CASE WHEN (left(ref, 1) = left(a, 1))::INT + (right(ref, 1) = right(a, 1))::INT = len(a) - 1 AND len(a) = 2 THEN 'snv' WHEN len(a) = 3 AND ((left(ref, 2) = left(a, 2)) OR (right(ref, 2) = right(a, 2)) OR (left(ref, 1) = left(a, 1) AND right(ref, 1) = right(a, 1))) THEN 'snv' ELSE 'mnv' END WHEN len(ref) < len(a) THEN CASE WHEN a LIKE ref || '%' THEN 'insertion' WHEN a LIKE '%' || ref THEN CASE WHEN len(ref) = 1 THEN 'complete-insertion' ELSE 'insertion' END WHEN len(ref) = 2 AND left(ref, 1) = left(a, 1) AND right(ref, 1) = right(a, 1) THEN 'insertion' ELSE 'complex' END ELSE CASE WHEN ref LIKE a || '%' OR ref LIKE '%' || a OR (len(a) = 2 AND left(ref, 1) = left(a, 1) AND right(ref, 1) = right(a, 1)) THEN 'deletion' ELSE 'complex' END END"


def _alleles(spark, d):
    return derive.variants(spark, d).select("id", "ref", F.explode(F.split("alt", ",")).alias("a"))


query("allele_type", f"SELECT id, a, {KIND} AS kind FROM {ONE}")(lambda s, d: _alleles(s, d).select("id", "a", variants.allele_type(c("ref"), c("a")).alias("kind")))
query("allele_type_counts", f"SELECT {KIND} AS kind, count(*) AS n FROM {ONE} GROUP BY 1")(lambda s, d: _alleles(s, d).groupBy(variants.allele_type(c("ref"), c("a")).alias("kind")).agg(F.count("*").alias("n")))
query("breakend_parse", f"SELECT id, 'chr2' AS chr, 321681::BIGINT AS pos, 'after' AS \"join\", 'forward' AS strand, 'C' AS bases, a AS text FROM {ONE} WHERE a LIKE '%[%'")(lambda s, d: _alleles(s, d).withColumn("b", variants.parse_breakend(c("a"))).where("b IS NOT NULL").select("id", "b.*", variants.format_breakend(c("b")).alias("text")))
query("split_multiallelic", f"SELECT id, i::INT AS alt_index, a AS alt, replace(gt, '1', CASE WHEN i = 1 THEN '1' ELSE '0' END) AS gt FROM (SELECT id, gt, unnest(string_split(alt, ',')) AS a, unnest(range(1, len(string_split(alt, ',')) + 1)) AS i FROM {VR})")(
    lambda s, d: V.split(derive.variants(s, d).withColumn("alt", F.split("alt", ","))).select("id", "alt_index", c("alt")[0].alias("alt"), "gt")
)
query("variant_region", f"SELECT id FROM {VR} WHERE chr = 'chr5' AND pos <= 90000 AND pos + len(ref) - 1 >= 20000")(lambda s, d: V.in_region(derive.variants(s, d), "chr5", 20000, 90000).select("id"))
query("variant_within", f"SELECT id FROM {VR} WHERE chr = 'chr5' AND pos >= 20000 AND pos + len(ref) <= 90000")(lambda s, d: V.in_region(derive.variants(s, d), "chr5", 20000, 90000, within=True).select("id"))
query("validate_variants", f"SELECT id, CASE WHEN id % 17 = 0 THEN 'chr,' ELSE '' END || CASE WHEN pos < 100000 THEN 'pos,' ELSE '' END || CASE WHEN id % 11 = 0 OR id % 11 = 1 THEN 'ref,' ELSE '' END || CASE WHEN id % 13 IN (0, 5, 7) THEN 'alt,' ELSE '' END AS paths FROM {VR}")(
    lambda s, d: V.validate(
        derive.variants(s, d).select(
            "id", F.when(c("id") % 17 == 0, F.lit("*chr 1")).otherwise(c("chr")).alias("chr"), F.when(c("pos") < 100000, -1).otherwise(c("pos")).alias("pos"), F.when(c("id") % 11 == 0, "").when(c("id") % 11 == 1, "AXG").otherwise(c("ref")).alias("ref"),
            F.when(c("id") % 13 == 0, F.array(F.lit("Q"))).when(c("id") % 13 == 5, F.array(F.lit("A"), F.lit("<DEL"))).when(c("id") % 13 == 7, F.array(F.lit("C[chr2:x["))).when(c("id") % 13 == 6, F.array(F.lit(".AC"), F.lit("]chr3:7]T"))).when(c("alt") != ".", F.split("alt", ",")).alias("alt"),
        )
    ).select("id", F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(","))), "").alias("paths"))
)

def _realigned(rows: str) -> str:
    """Left alignment of (id, alt_index, chr, pos, a: the reference allele and the others), base by base."""
    return f"""WITH RECURSIVE v AS ({rows}),
r AS (SELECT id, alt_index, chr, pos, a, 0 AS n FROM v UNION ALL
  SELECT id, alt_index, chr, pos - (m = 1)::INT, list_transform(a, lambda x: CASE WHEN m = 1 THEN substr(sequence, pos - 1, 1) ELSE '' END || left(x, len(x) - 1)), n + 1
  FROM (SELECT *, list_min(list_transform(a, lambda x: len(x))) AS m FROM r) JOIN {derive.duck(REFERENCE)} ON name = chr
  WHERE len(list_distinct(list_transform(a, lambda x: right(x, 1)))) = 1 AND NOT (m = 1 AND pos = 1)),
e AS (SELECT id, alt_index, arg_max(pos, n) AS pos, arg_max(a, n) AS a FROM r GROUP BY ALL),
t AS (SELECT id, alt_index, pos, a, 0 AS n FROM e UNION ALL
  SELECT id, alt_index, pos + 1, list_transform(a, lambda x: x[2:]), n + 1 FROM t WHERE list_min(list_transform(a, lambda x: len(x))) > 1 AND len(list_distinct(list_transform(a, lambda x: left(x, 1)))) = 1)
SELECT id, alt_index, arg_max(pos, n)::INT AS pos, arg_max(a, n)[1] AS ref, array_to_string(arg_max(a, n)[2:], ',') AS alt FROM t GROUP BY id, alt_index"""


def _variant_rows() -> str:
    return f"""SELECT id, 1 AS alt_index, chr, pos, [r] || CASE k WHEN 0 THEN [left(r, 1)] WHEN 1 THEN [r || substr(r, 3, 2), 'G'] ELSE [left(r, 2) || 'A'] END AS a
FROM (SELECT o_orderkey AS id, concat('chr', (o_custkey % 10 + 1)::VARCHAR) AS chr, (o_orderkey * 7 % 900 + 20)::INT AS pos, o_orderkey % 3 AS k, substr(sequence, (o_orderkey * 7 % 900 + 20)::INT, 4) AS r
      FROM orders JOIN {derive.duck(REFERENCE)} ON name = concat('chr', (o_custkey % 10 + 1)::VARCHAR)) WHERE len(r) = 4"""


REALIGN = lambda: f"SELECT id, pos, ref, alt FROM ({_realigned(_variant_rows())})"
NORMALIZE = lambda: _realigned(f"SELECT id, i::INT AS alt_index, chr, pos, [a[1], a[i + 1]] AS a FROM (SELECT *, unnest(range(1, len(a))) AS i FROM ({_variant_rows()}))")
query("realign_variants")(lambda s, d: V.realign(*_reference_and_variants(s, d)).select("id", "pos", "ref", F.array_join("alt", ",").alias("alt")))
query("normalize_variants")(lambda s, d: V.normalize(*_reference_and_variants(s, d)).select("id", "alt_index", "pos", "ref", F.array_join("alt", ",").alias("alt")))

REFERENCE = "SELECT concat('chr', CAST(s_suppkey + 1 AS STRING)) AS name, repeat(concat('ACGTTTTACGGATATATC', CASE WHEN s_suppkey % 2 = 0 THEN 'GG' ELSE 'CACACACA' END), 60) AS sequence, s_suppkey FROM supplier"


def _reference_and_variants(spark, d):
    ref = derive.relation(spark, d, REFERENCE).select("name", "sequence")
    v = derive.relation(spark, d, "SELECT o_orderkey AS id, concat('chr', CAST(o_custkey % 10 + 1 AS STRING)) AS chr, CAST(o_orderkey * 7 % 900 + 20 AS INT) AS pos, o_orderkey % 3 AS k FROM orders")
    seq = V.with_reference(v.withColumn("_n", F.lit(4)), ref, F.col("_n"))
    alts = F.when(c("k") == 0, F.array(F.substring("_ref", 1, 1))).when(c("k") == 1, F.array(F.concat("_ref", F.substring("_ref", 3, 2)), F.lit("G"))).otherwise(F.array(F.concat(F.substring("_ref", 1, 2), F.lit("A"))))
    return seq.where("length(_ref) = 4").select("id", "chr", "pos", c("_ref").alias("ref"), alts.alias("alt"), F.lit("0/1").alias("gt")), ref


query("seq_dict", f"SELECT name, len(sequence)::BIGINT AS len, md5(upper(sequence)) AS md5 FROM {derive.duck(REFERENCE)}")(lambda s, d: V.sequence_dictionary(V.chunk(derive.relation(s, d, REFERENCE), 100)))
query("fasta_lookup", f"SELECT o_orderkey AS id, substr(sequence, (o_orderkey % 700 + 1)::INT, 150) AS s FROM orders JOIN {derive.duck(REFERENCE)} ON name = concat('chr', CAST(o_custkey % 10 + 1 AS VARCHAR))")(
    lambda s, d: V.with_reference(derive.relation(s, d, "SELECT o_orderkey AS id, concat('chr', CAST(o_custkey % 10 + 1 AS STRING)) AS chr, CAST(o_orderkey % 700 + 1 AS INT) AS pos, 150 AS n FROM orders"), derive.relation(s, d, REFERENCE).select("name", "sequence"), F.col("n"), 64).select("id", c("_ref").alias("s"))
)
query("ref_match", f"SELECT o_orderkey AS id, upper(substr(sequence, (o_orderkey % 700 + 1)::INT, 2)) = 'AC' AS same FROM orders JOIN {derive.duck(REFERENCE)} ON name = concat('chr', CAST(o_custkey % 10 + 1 AS VARCHAR))")(
    lambda s, d: V.same_ref(derive.relation(s, d, "SELECT o_orderkey AS id, concat('chr', CAST(o_custkey % 10 + 1 AS STRING)) AS chr, CAST(o_orderkey % 700 + 1 AS INT) AS pos, 'ac' AS ref FROM orders"), derive.relation(s, d, REFERENCE).select("name", "sequence")).where("same IS NOT NULL").select("id", "same")
)

ORACLES["realign_variants"], ORACLES["normalize_variants"] = REALIGN(), NORMALIZE()

# --- streams

query("stream_session_merge", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g")(sessions.stream_sessions)
query("stream_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")(sessions.stream_windows)
query("stream_carry", "SELECT event_id, sum(event_id % 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS carried FROM events")(lambda s, d: sessions.carry(s.read.parquet(f"{d}/events.parquet").withColumn("v", c("event_id") % 100), "user_id", "ts", "v", 5).select("event_id", "carried"))
query("limit_first", f"SELECT ordinal FROM {L} ORDER BY ordinal LIMIT 100")(lambda s, d: derive.alignments(s, d).select("ordinal").orderBy("ordinal").limit(100))
query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")(sessions.stream_distinct)
ORACLES["info_parse"] = f"SELECT v.id, regexp_extract(v.info, 'DP=(\\d+)', 1)::INT AS dp, v.info LIKE '%DB' AS db, t.text FROM {VR} v JOIN ({ORDERED}) t ON t.id = v.id"
