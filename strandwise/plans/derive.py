"""Genomic-shaped relations over the driver's tables, as SQL that Spark and DuckDB both read.

Positions are 1-based and closed. Only integers and strings are derived, so both engines give equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: length of every derived reference sequence
LENGTH = 1_000_000

INTERVALS = """
SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chr,
       (l_orderkey * 31 + l_linenumber * 7) % 900000 + 1 AS pos_s,
       (l_orderkey * 31 + l_linenumber * 7) % 900000 + 1 + CAST(l_quantity AS INT) * 3 AS pos_e,
       ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id
FROM lineitem
"""
OTHERS = """
SELECT concat('chr', CAST(o_custkey % 22 + 1 AS STRING)) AS chr,
       (o_orderkey * 37 + o_custkey * 11) % 900000 + 1 AS pos_s,
       (o_orderkey * 37 + o_custkey * 11) % 900000 + 1 + o_custkey % 200 AS pos_e,
       o_orderkey AS id
FROM orders
"""
ALIGNMENTS = """
SELECT concat('q', CAST(l_orderkey AS STRING)) AS qname,
       CASE l_linenumber WHEN 1 THEN 99 WHEN 2 THEN 147 WHEN 3 THEN 0 WHEN 4 THEN 16 WHEN 5 THEN 1024 WHEN 6 THEN 256 ELSE 4 END AS flag,
       CASE WHEN l_linenumber < 7 THEN concat('chr', CAST(l_orderkey % 5000 % 22 + 1 AS STRING)) ELSE '*' END AS rname,
       CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber = 2 THEN l_orderkey % 5000 * 31 + l_orderkey % 50 + 1 ELSE l_orderkey % 5000 * 31 + 1 END AS pos,
       l_partkey % 61 AS mapq,
       CASE WHEN l_linenumber = 7 THEN '*' ELSE CASE l_partkey % 6 WHEN 0 THEN '10M' WHEN 1 THEN '3S7M' WHEN 2 THEN '4M2I4M' WHEN 3 THEN '5M3D5M' WHEN 4 THEN '4M20N6M' ELSE '2H8M' END END AS cigar,
       CASE WHEN l_linenumber <= 2 THEN '=' ELSE '*' END AS rnext,
       CASE l_linenumber WHEN 1 THEN l_orderkey % 5000 * 31 + l_orderkey % 50 + 1 WHEN 2 THEN l_orderkey % 5000 * 31 + 1 ELSE 0 END AS pnext,
       CASE l_linenumber WHEN 1 THEN l_orderkey % 50 + 10 WHEN 2 THEN -(l_orderkey % 50 + 10) ELSE 0 END AS tlen,
       substr('ACGTTGCAACGTTGCAACGTTGCA', CAST(l_partkey % 8 + 1 AS INT), CASE WHEN l_partkey % 6 = 5 THEN 8 ELSE 10 END) AS seq,
       substr('IIII5555####ABCDEFGHIJKL', CAST(l_suppkey % 9 + 1 AS INT), CASE WHEN l_partkey % 6 = 5 THEN 8 ELSE 10 END) AS qual,
       ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ordinal
FROM lineitem
"""
VARIANTS = """
SELECT concat('chr', CAST(o_custkey % 22 + 1 AS STRING)) AS chr,
       (o_orderkey * 13) % 900000 + 1 AS pos,
       CASE o_orderkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' WHEN 2 THEN 'G' WHEN 3 THEN 'ATT' WHEN 4 THEN 'C' WHEN 5 THEN 'GAT' ELSE 'T' END AS ref,
       CASE o_orderkey % 9 WHEN 0 THEN 'G' WHEN 1 THEN 'A,C' WHEN 2 THEN 'GTA' WHEN 3 THEN 'A' WHEN 4 THEN '<DEL>' WHEN 5 THEN '*' WHEN 6 THEN 'C[chr2:321681[' WHEN 7 THEN 'T,GA,AT' ELSE '.' END AS alt,
       concat('DP=', CAST(o_custkey % 90 AS STRING), ';AF=0.', CAST(o_custkey % 10 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ';DB' ELSE '' END) AS info,
       CASE o_orderkey % 6 WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' WHEN 2 THEN './.' WHEN 3 THEN '1/1' WHEN 4 THEN '0|0' ELSE '1/.' END AS gt,
       o_orderkey AS id
FROM orders
"""
REFS = "SELECT DISTINCT concat('chr', CAST(n_nationkey % 22 + 1 AS STRING)) AS name, CAST(1000000 AS BIGINT) AS len, CAST(n_nationkey % 22 AS BIGINT) AS idx FROM nation"


def duck(sql: str) -> str:
    """The same relation for DuckDB."""
    return "(" + sql.replace("AS STRING", "AS VARCHAR") + ")"


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table = sql.rsplit("FROM", 1)[1].split()[0]
    view = f"strandwise_{table}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
    out = spark.sql(sql.rsplit("FROM", 1)[0] + f"FROM {view}")
    return out.withColumnsRenamed({"pos_s": "start", "pos_e": "end"})


def intervals(spark, sf_dir):
    return relation(spark, sf_dir, INTERVALS)


def others(spark, sf_dir):
    return relation(spark, sf_dir, OTHERS)


def alignments(spark, sf_dir):
    return relation(spark, sf_dir, ALIGNMENTS).withColumns({"flag": _int("flag"), "pos": _int("pos"), "mapq": _int("mapq"), "pnext": _int("pnext"), "tlen": _int("tlen")})


def variants(spark, sf_dir):
    return relation(spark, sf_dir, VARIANTS)


def refs(spark, sf_dir):
    return relation(spark, sf_dir, REFS)


def _int(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("int")
