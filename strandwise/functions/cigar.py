"""CIGAR strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OP = r"(\d+)([MIDNSHP=X])"
ON_REFERENCE = ("M", "D", "N", "=", "X")
ON_QUERY = ("M", "I", "S", "=", "X")


def parse(cigar: Column) -> Column:
    """array<struct<n, op>>; what doesn't match is skipped."""
    counts, ops = F.regexp_extract_all(cigar, F.lit(OP), F.lit(1)), F.regexp_extract_all(cigar, F.lit(OP), F.lit(2))
    return F.transform(F.arrays_zip(counts.alias("n"), ops.alias("op")), lambda x: F.struct(x["n"].cast("int").alias("n"), x["op"].alias("op")))


def to_string(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def simplify(cigar: Column) -> Column:
    """Adjacent equal operations merged, as a string."""

    def add(acc, x):
        last = F.element_at(acc, -1)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["n"] + x["n"]).alias("n"), x["op"].alias("op"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["op"] == x["op"]), merged).otherwise(F.concat(acc, F.array(x)))

    start = F.array().cast("array<struct<n:int,op:string>>")
    safe = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(add(acc, x))
    return to_string(F.aggregate(parse(cigar), start, safe))


def length_of(cigar: Column, ops: tuple[str, ...]) -> Column:
    counts = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{''.join(ops)}]"), F.lit(1))
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x.cast("int"))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment spans."""
    return length_of(cigar, ON_REFERENCE)


def query_length(cigar: Column) -> Column:
    return length_of(cigar, ON_QUERY)


def count_ops(cigar: Column) -> Column:
    return F.size(F.regexp_extract_all(cigar, F.lit(OP), F.lit(0)))


def end(pos: Column, cigar: Column) -> Column:
    """Last reference position; pos itself if the CIGAR spans none."""
    return pos + F.greatest(reference_length(cigar) - 1, F.lit(0))


def encode(cigar: Column) -> Column:
    """array<long> of n << 4 | operation number, as BAM has it."""
    return F.transform(parse(cigar), lambda x: F.shiftleft(x["n"].cast("long"), 4).bitwiseOR((F.instr(F.lit("MIDNSHP=X"), x["op"]) - 1).cast("long")))


def decode(encoded: Column) -> Column:
    return F.array_join(F.transform(encoded, lambda x: F.concat(F.shiftright(x, 4).cast("string"), F.substring(F.lit("MIDNSHP=X"), (x.bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1)))), "")


def is_placeholder(cigar: Column) -> Column:
    """A CIGAR of kSmN, which stands for one that is too long for the record."""
    return cigar.rlike(r"^\d+S\d+N$")


def aligned(cigar: Column) -> Column:
    """array<struct<ref, query, kind, indel, indel_start, indel_len>>: one entry a reference base, in order.

    ref counts from 0; kind is m (base at query, from 0), d (deleted) or n (skipped). An insertion or deletion hangs on
    the entry before it, if that is a plain base or skip; a leading insertion is dropped.
    """
    step = "struct<ref:int,query:int,out:array<struct<ref:int,query:int,kind:string,indel:string,indel_start:int,indel_len:int>>>"
    empty = F.from_json(F.lit('{"ref":0,"query":0,"out":[]}'), step)

    def entry(ref, query, kind):
        return F.struct(ref.cast("int").alias("ref"), query.cast("int").alias("query"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("indel"), F.lit(None).cast("int").alias("indel_start"), F.lit(None).cast("int").alias("indel_len"))

    def run(acc, n, kind):
        at = F.sequence(F.lit(0), n - 1)
        return F.transform(at, lambda i: entry(acc["ref"] + i, acc["query"] + i if kind == "m" else F.lit(None), kind))

    def hang(acc, kind, n):
        out, last = acc["out"], F.get(acc["out"], F.size(acc["out"]) - 1)
        new = F.struct(last["ref"].alias("ref"), last["query"].alias("query"), last["kind"].alias("kind"), F.lit(kind).alias("indel"), acc["query"].cast("int").alias("indel_start"), n.cast("int").alias("indel_len"))
        return F.when((F.size(out) > 0) & last["kind"].isin("m", "n") & last["indel"].isNull(), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(new))).otherwise(out)

    def make(ref, query, out):
        return F.struct(ref.cast("int").alias("ref"), query.cast("int").alias("query"), out.alias("out"))

    def add(acc, x):
        n, op = x["n"], x["op"]
        return (
            F.when(op.isin("M", "=", "X"), make(acc["ref"] + n, acc["query"] + n, F.concat(acc["out"], run(acc, n, "m"))))
            .when(op == "D", make(acc["ref"] + n, acc["query"], F.concat(hang(acc, "d", n), run(acc, n, "d"))))
            .when(op == "N", make(acc["ref"] + n, acc["query"], F.concat(acc["out"], run(acc, n, "n"))))
            .when(op == "I", make(acc["ref"], acc["query"] + n, hang(acc, "i", n)))
            .when(op == "S", make(acc["ref"], acc["query"] + n, acc["out"]))
            .otherwise(acc)
        )

    ops = F.filter(parse(simplify(F.regexp_replace(cigar, r"\d+[PH]", ""))), lambda x: x["n"] > 0)
    return F.aggregate(ops, empty, add)["out"]
