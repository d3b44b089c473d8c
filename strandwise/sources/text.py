"""Text formats as DataFrames: readers and writers.

Formats of one line a record are `spark.read.text` and expressions, so files split and filters prune columns. FASTQ is
read in byte ranges that begin at a record. FASTA without an index and WIG, whose lines depend on earlier ones, are read a
file at a time by Arrow passes over the files; an indexed FASTA is read in chunks (see `indexed`).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import cigar as C
from ..functions import regions, tags
from ..functions import variants as V
from ..storage import numbered

SAM_FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and an order of lines that grows within a file."""
    return spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())


# --- SAM


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname .. qual, end, options array<struct<tag,type,value>>, ordinal. Names can't begin with @, so header lines are told by it."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    d = _lines(spark, path).where((F.col("value") != "") & ~F.col("value").rlike(r"^@[A-Z][A-Z]\t"))
    cols = [(F.upper(at(i)) if k == "seq" else at(i).cast("int") if k in ints else at(i)).alias(k) for i, k in enumerate(SAM_FIELDS)]
    d = d.select(*cols, tags.parse(F.slice(f, 12, 1 << 20)).alias("options"), "ordinal")
    return d.withColumn("end", C.end(F.col("pos"), F.col("cigar")))


def parse_sam_header(lines: list[str]) -> dict:
    """{"HD": {..}, "SQ": [..], "RG": [..], "PG": [..], "CO": [..]}; LN and PI are numbers."""
    out: dict = {}
    for line in lines:
        kind, _, rest = line[1:].partition("\t")
        if kind == "CO":
            out.setdefault("CO", []).append(rest)
            continue
        fields = dict(x.split(":", 1) for x in rest.split("\t") if ":" in x)
        fields = {k: int(v) if k in ("LN", "PI") else v for k, v in fields.items()}
        if kind == "HD":
            out["HD"] = fields
        else:
            out.setdefault(kind, []).append(fields)
    return out


def format_sam_header(header: dict) -> list[str]:
    one = lambda kind, f: "@" + kind + "".join(f"\t{k}:{v}" for k, v in f.items())
    out = [one("HD", header["HD"])] if "HD" in header else []
    for kind in ("SQ", "RG", "PG"):
        out += [one(kind, f) for f in header.get(kind, [])]
    return out + [f"@CO\t{x}" for x in header.get("CO", [])]


def with_sort_order(header: dict, order: str, version: str = "1.4") -> dict:
    return header | {"HD": {"VN": version} | header.get("HD", {}) | {"SO": order}}


def sort_order(header: dict) -> str:
    return header.get("HD", {}).get("SO", "unknown")


def read_sam_header(spark: SparkSession, path: str) -> dict:
    """Only header lines come to the driver."""
    rows = _lines(spark, path).where(F.col("value").rlike(r"^@[A-Z][A-Z]\t")).orderBy("ordinal").collect()
    return parse_sam_header([r["value"] for r in rows])


def header_refs(spark: SparkSession, header: dict) -> DataFrame:
    return spark.createDataFrame([(s["SN"], int(s["LN"]), i) for i, s in enumerate(header.get("SQ", []))], "name string, len long, idx long")


def sam_line() -> Column:
    options = F.array_join(tags.to_fields(F.col("options")), "\t")
    fields = F.concat_ws("\t", *[F.col(k).cast("string") for k in SAM_FIELDS])
    return F.when(F.size("options") > 0, F.concat(fields, F.lit("\t"), options)).otherwise(fields)


def write_sam(alignments: DataFrame, path: str, header: dict | None = None) -> None:
    """A folder of part files, the first with the header; records keep their order."""
    _write_lines(alignments.select(sam_line().alias("value")), path, format_sam_header(header or {}))


def _write_lines(lines: DataFrame, path: str, header: list[str] = (), compression: str | None = None) -> None:
    """Lines with a header before the first, as text; the header is a partition of its own before the others."""
    if header:
        spark = lines.sparkSession
        lines = spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).union(lines)
    w = lines.write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)


# --- BED

BED = ("chr", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count", "block_sizes", "block_starts")


def read_bed(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """BED3 to BED12 as 1-based closed intervals. strict=True fails on a line whose start isn't before its end."""
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit("."))
    longs = lambda i: F.transform(F.filter(F.split(at(i), ","), lambda x: x != ""), lambda x: x.cast("long"))
    d = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$|^(browser|track)(\s|$)|^#"))
    strand = F.when(at(5) == "+", "forward").when(at(5) == "-", "reverse")
    d = d.select(
        at(0).alias("chr"), (at(1).cast("long") + 1).alias("start"), at(2).cast("long").alias("end"), at(3).alias("name"), at(4).cast("int").alias("score"), strand.alias("strand"),
        (at(6).cast("long") + 1).alias("thick_start"), at(7).cast("long").alias("thick_end"), at(8).alias("item_rgb"), at(9).cast("int").alias("block_count"), longs(10).alias("block_sizes"), longs(11).alias("block_starts"),
    )
    if strict:
        good = (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & F.coalesce(F.col("score").between(0, 1000), F.lit(True)) & F.coalesce(F.size("block_sizes") == F.col("block_count"), F.lit(True))
        d = d.withColumn("chr", F.when(F.coalesce(good, F.lit(False)), F.col("chr")).otherwise(F.raise_error("malformed BED line")))
    return d


def bed_line(width: int = 12) -> Column:
    strand = F.when(F.col("strand") == "forward", "+").when(F.col("strand") == "reverse", "-")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    values = [F.col("chr"), F.col("start") - 1, F.col("end"), F.col("name"), F.col("score"), strand, F.col("thick_start") - 1, F.col("thick_end"), F.col("item_rgb"), F.col("block_count"), joined("block_sizes"), joined("block_starts")]
    return F.concat_ws("\t", *[F.coalesce(v.cast("string"), F.lit(".")) for v in values[:width]])


def write_bed(features: DataFrame, path: str, width: int | None = None) -> None:
    width = width or max(i + 1 for i, k in enumerate(BED) if k in features.columns)
    _write_lines(features.select(bed_line(width).alias("value")), path)


# --- VCF

META = re.compile(r'([^=,]+)=("(?:[^"\\]|\\.)*"|[^,]*)')


def parse_meta(lines: list[str]) -> dict:
    """Meta-information by lower-case key: structured lines as dicts in lists, others as text; the column names as "columns"."""
    out: dict = {}
    for line in lines:
        if not line.startswith("##"):
            out["columns"] = line[1:].split("\t")
            continue
        key, _, value = line[2:].partition("=")
        key = key.lower()
        if value.startswith("<") and value.endswith(">"):
            fields = {k.lower(): re.sub(r"\\(.)", r"\1", v[1:-1]) if v.startswith('"') else v for k, v in META.findall(value[1:-1])}
            out.setdefault(key, []).append(fields)
        else:
            out[key] = value
    return out


QUOTED = {"description", "source", "version"}


def format_meta(meta: dict) -> list[str]:
    def quote(k, v):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if k in QUOTED else v

    names = {"id": "ID", "number": "Number", "type": "Type", "description": "Description", "source": "Source", "version": "Version", "url": "URL"}
    out = [f"##fileformat={meta['fileformat']}"] if "fileformat" in meta else []
    out += [f"##{k}={v}" for k, v in meta.items() if isinstance(v, str) and k != "fileformat"]
    for key in ("contig", "info", "filter", "format", "alt", "sample", "pedigree"):
        shown = key if key == "contig" else key.upper()
        out += [f"##{shown}=<" + ",".join(f"{names.get(k, k)}={quote(k, v)}" for k, v in f.items()) + ">" for f in meta.get(key, [])]
    return out + (["#" + "\t".join(meta["columns"])] if "columns" in meta else [])


def read_vcf_meta(spark: SparkSession, path: str) -> dict:
    rows = _lines(spark, path).where(F.col("value").startswith("#")).orderBy("ordinal").collect()
    return parse_meta([r["value"] for r in rows])


def read_vcf(spark: SparkSession, path: str, meta: dict | None = None) -> DataFrame:
    """chr, pos, id, ref, alt, qual, filter, info map, format, samples array<struct<name,values>>, info_text, ordinal."""
    return vcf_rows(_lines(spark, path), meta or read_vcf_meta(spark, path))


def vcf_rows(lines: DataFrame, meta: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """Variants of lines (value, ordinal), with the columns of `keep`."""
    names = meta.get("columns", [])[9:]
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    d = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    fmt = V.split_field(at(8), ":")
    samples = F.array(*[F.struct(F.lit(n).alias("name"), V.parse_sample(fmt, at(9 + i)).alias("values")) for i, n in enumerate(names)]) if names else F.lit(None)
    return d.select(
        at(0).alias("chr"), at(1).cast("long").alias("pos"), F.nullif(at(2), F.lit(".")).alias("id"), at(3).alias("ref"), V.split_field(at(4), ",").alias("alt"),
        F.when(~V.missing(at(5)), at(5)).cast("double").alias("qual"), V.split_field(at(6), ";").alias("filter"), V.parse_info(at(7)).alias("info"), fmt.alias("format"), samples.alias("samples"), at(7).alias("info_text"), "ordinal", *keep,
    )


def typed_info(meta: dict, names: list[str]) -> list[Column]:
    """Columns of INFO values by their declared Number and Type; an undeclared name is an error."""
    kinds = {"Integer": "int", "Float": "double", "Flag": "boolean", "String": "string", "Character": "string"}
    declared = {f["id"]: f for f in meta.get("info", [])}
    out = []
    for n in names:
        if n not in declared:
            raise ValueError(f"undeclared INFO: {n}")
        x, kind = F.col("info")[n], kinds[declared[n]["type"]]
        if kind == "boolean":
            out.append(F.coalesce(F.map_contains_key("info", n), F.lit(False)).alias(n))
        elif declared[n]["number"] == "1":
            out.append(F.get(x, F.lit(0)).try_cast(kind).alias(n))
        else:
            out.append(x.try_cast(f"array<{kind}>").alias(n))
    return out


def typed_samples(meta: dict, names: list[str]) -> Column:
    """array<struct<name, ..>> of the samples' FORMAT values by their declared Number and Type; an undeclared name is an error."""
    kinds = {"Integer": "int", "Float": "double", "String": "string", "Character": "string"}
    declared = {f["id"]: f for f in meta.get("format", [])}
    if missing := [n for n in names if n not in declared]:
        raise ValueError(f"undeclared FORMAT: {missing[0]}")

    def one(s):
        fields = [s["name"].alias("name")]
        for n in names:
            x, kind = s["values"][n], kinds[declared[n]["type"]]
            fields.append((F.get(x, F.lit(0)).try_cast(kind) if declared[n]["number"] == "1" else x.try_cast(f"array<{kind}>")).alias(n))
        return F.struct(*fields)

    return F.transform("samples", one)


def typed_variants(variants: DataFrame, meta: dict) -> DataFrame:
    """Variants whose info is a struct and whose samples are structs, by all that the meta-information declares."""
    info, fmt = ([f["id"] for f in meta.get(k, [])] for k in ("info", "format"))
    out = variants.withColumn("info", F.struct(*typed_info(meta, info))) if info else variants
    return out.withColumn("samples", typed_samples(meta, fmt)) if fmt and dict(variants.dtypes)["samples"] != "void" else out


def vcf_line(samples: list[str]) -> Column:
    dot = lambda c: F.coalesce(c, F.lit("."))
    fixed = [F.col("chr"), F.col("pos").cast("string"), dot(F.col("id")), F.col("ref"), dot(F.array_join("alt", ",")), V.format_quality(F.col("qual")), dot(F.array_join("filter", ";")), F.coalesce(F.nullif(F.col("info_text"), F.lit("")), V.format_info(F.col("info")))]
    each = [V.format_sample(F.col("format"), F.get("samples", F.lit(i))["values"]) for i in range(len(samples))]
    return F.concat_ws("\t", *fixed, *([dot(F.array_join("format", ":")), *each] if samples else []))


def write_vcf(variants: DataFrame, path: str, meta: dict, compression: str | None = None) -> None:
    _write_lines(variants.select(vcf_line(meta.get("columns", [])[9:]).alias("value")), path, format_meta(meta), compression)


# --- formats in which a line depends on those before it


def _by_file(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """parse(lines) gives tuples for one file's lines; a file is read by one task, as a stream."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import bz2
        import gzip
        import io


        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                opener = gzip.open if name.endswith((".gz", ".bgz")) else bz2.open if name.endswith(".bz2") else None
                raw = opener(io.BytesIO(content)) if opener else io.BytesIO(content)
                held = []
                for row in parse(x.rstrip("\r\n") for x in io.TextIOWrapper(raw, "utf-8")):
                    held.append(row)
                    if len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=target)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=target)

    fields = StructType.fromDDL(schema)
    target = to_arrow_schema(fields)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, fields)


def read_fasta(spark: SparkSession, path: str, mask: bool = False, width: int = 1 << 16) -> DataFrame:
    """name, description, chunk, bases: sequences in chunks of `width` bases; upper-case unless mask."""

    def parse(lines):
        name = desc = None
        held, size, number = [], 0, 0
        for line in lines:
            if line.startswith(">"):
                if name is not None and (size or not number):
                    yield name, desc, number, "".join(held)
                m = re.match(r">\s*([^\s|]*)[\s|]?(.*)", line)
                name, desc, held, size, number = m.group(1), m.group(2) or None, [], 0, 0
            elif name is not None:
                text = line.strip() if mask else line.strip().upper()
                held.append(text)
                size += len(text)
                while size >= width:
                    whole = "".join(held)
                    yield name, desc, number, whole[:width]
                    held, size, number = [whole[width:]], size - width, number + 1
        if name is not None and (size or not number):
            yield name, desc, number, "".join(held)

    return _by_file(spark, path, parse, "name string, description string, chunk int, bases string")


def fasta_lines(cols: int = 80):
    """Text of whole sequences (name, sequence), wrapped."""
    wrapped = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{cols}}})", "$1\n"), "\n$", "")
    return F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped)


def write_fasta(sequences: DataFrame, path: str, cols: int = 80) -> None:
    _write_lines(sequences.select(fasta_lines(cols).alias("value")), path)


def fasta_index(lines) -> list[tuple[str, int, int, int, int]]:
    """(name, length, offset, bases a line, bytes a line) of each sequence of a file's byte lines."""
    out, at = [], 0
    for line in lines:
        text = line.rstrip(b"\r\n")
        if text.startswith(b">"):
            out.append([re.match(rb">\s*([^\s|]*)", text).group(1).decode(), 0, at + len(line), 0, 0])
        elif out:
            if not out[-1][3]:
                out[-1][3:] = [len(text), len(line)]
            out[-1][1] += len(text)
        at += len(line)
    return [tuple(x) for x in out]


class _Piece(InputPartition):
    def __init__(self, path: str, beg: int, end: int | None):
        super().__init__((path, beg, end))
        self.path, self.beg, self.end = path, beg, end


def _records(lines):
    """(name, sequence, quality) of lines of bytes."""
    it = iter(lines)
    for head in it:
        head = head.rstrip(b"\r\n")
        if not head:
            continue
        sequence, plus, quality = (next(it, b"").rstrip(b"\r\n") for _ in range(3))
        if not head.startswith(b"@") or not plus.startswith(b"+") or len(sequence) != len(quality):
            raise ValueError(f"malformed FASTQ record: {head.decode()}")
        yield head[1:].decode(), sequence.decode(), quality.decode()


def _first_read(raw, offset: int) -> int:
    """Where the first record at or after a byte offset begins: @ on a line, + two lines on, and lines as long as one another."""
    raw.seek(max(offset - 1, 0))
    if offset:
        raw.readline()
    held: list[tuple[int, bytes]] = []
    while True:
        at, line = raw.tell(), raw.readline()
        held.append((at, line.rstrip(b"\r\n")))
        if len(held) == 4:
            (first, a), (_, s), (_, plus), (_, q) = held
            if a.startswith(b"@") and plus.startswith(b"+") and len(s) == len(q):
                return first
            held.pop(0)
        if not line:
            return at


class _FastqReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.split = json.loads(options["files"]), int(options.get("split", 64 << 20))

    def partitions(self):
        out = []
        for path, size in self.files:
            whole = path.endswith((".gz", ".bz2", ".bgz"))
            out += [_Piece(path, 0, None)] if whole else [_Piece(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out or [_Piece("", 0, 0)]

    def read(self, piece):
        import bz2
        import gzip

        from pyarrow import fs

        schema, held = pa.schema([(n, pa.string()) for n in ("name", "sequence", "quality")]), []
        if not piece.path:
            return
        system, root = fs.FileSystem.from_uri(piece.path)
        with system.open_input_file(root) as raw:
            if piece.end is None:
                lines = (bz2 if piece.path.endswith(".bz2") else gzip).open(raw)
            else:
                import io

                raw = io.BufferedReader(raw, 1 << 20)
                first, last = _first_read(raw, piece.beg), _first_read(raw, piece.end)
                raw.seek(first)

                def upto(end=last):
                    while raw.tell() < end:
                        for _ in range(4):
                            yield raw.readline()

                lines = upto()
            for row in _records(lines):
                held.append(row)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], schema=schema)


class FastqSource(DataSource):
    """format("fastq"): name, sequence, quality; options files (JSON of [URI, size]), split (bytes; compressed files don't)."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "name string, sequence string, quality string"

    def reader(self, schema):
        return _FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """name, sequence, quality; a file is read in byte ranges."""
    spark.dataSource.register(FastqSource)
    listed = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # names and sizes only
    files = [(re.sub("^file:/+", "file:///", r["path"]), r["length"]) for r in sorted(listed)]
    return spark.read.format("fastq").option("files", json.dumps(files)).option("split", str(split)).load()


def write_fastq(reads: DataFrame, path: str, compression: str | None = None) -> None:
    _write_lines(reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("value")), path, compression=compression)


def _decoded(x: Column) -> Column:
    """Percent signs undone; a plus is a plus."""
    return F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """chr, source, type, start, end, score, strand, phase, attributes map<string,array<string>>.

    Lines are independent of one another, so files split; what follows ##FASTA has no columns and is left out.
    """
    lines = spark.read.text(path)
    if not lines.where(F.col("value").rlike(r"^##gff-version\s+3")).limit(1).count():
        raise ValueError("not a GFF3 file")
    f = F.split("value", "\t")
    at = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit("."))
    strand = F.when(at(6) == "+", "forward").when(at(6) == "-", "reverse").when(at(6) == "?", "unknown")
    pairs = F.filter(F.split(F.coalesce(at(8), F.lit("")), ";"), lambda x: x.contains("="))
    entry = lambda x: F.struct(_decoded(F.trim(F.substring_index(x, "=", 1))).alias("key"), F.transform(F.split(F.substr(x, F.instr(x, "=") + 1), ","), _decoded).alias("value"))
    return lines.where(~F.col("value").rlike("^[#>]") & (F.size(f) >= 8)).select(
        _decoded(at(0)).alias("chr"), _decoded(at(1)).alias("source"), _decoded(at(2)).alias("type"), at(3).cast("long").alias("start"), at(4).cast("long").alias("end"), at(5).cast("double").alias("score"),
        strand.alias("strand"), at(7).cast("int").alias("phase"), F.map_from_entries(F.transform(pairs, entry)).alias("attributes"),
    )


def gff_target(x: Column) -> Column:
    """struct<id, start, end, strand> of a Target attribute: `id start end [strand]`."""
    f = F.split(x, " ")
    return F.when(F.size(f) >= 3, F.struct(F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), F.when(F.get(f, F.lit(3)) == "+", "forward").when(F.get(f, F.lit(3)) == "-", "reverse").alias("strand")))


def format_gff_target(t: Column) -> Column:
    return F.concat_ws(" ", t["id"], t["start"].cast("string"), t["end"].cast("string"), F.when(t["strand"] == "forward", "+").when(t["strand"] == "reverse", "-"))


def gff_gap(x: Column) -> Column:
    """array<struct<op, n>> of a Gap attribute: `M8 D3 M6`."""
    return F.transform(F.filter(F.split(x, " "), lambda g: g != ""), lambda g: F.struct(F.substring(g, 1, 1).alias("op"), F.substr(g, F.lit(2)).try_cast("int").alias("n")))


def format_gff_gap(gap: Column) -> Column:
    return F.array_join(F.transform(gap, lambda g: F.concat(g["op"], g["n"].cast("string"))), " ")


def gff_reference(x: Column) -> Column:
    """struct<db, id> of a Dbxref or Ontology_term: `db:id`, the first colon dividing them."""
    return F.when(x.contains(":"), F.struct(F.substring_index(x, ":", 1).alias("db"), F.substr(x, F.instr(x, ":") + 1).alias("id")))


def format_gff_reference(r: Column) -> Column:
    return F.concat(r["db"], F.lit(":"), r["id"])


def write_gff(features: DataFrame, path: str) -> None:
    def escape(x, more):
        for ch in "%" + more + "\t\n\r":
            x = F.replace(x, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
        return x

    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    strand = F.when(F.col("strand") == "forward", "+").when(F.col("strand") == "reverse", "-").when(F.col("strand") == "unknown", "?")
    score = F.when(F.col("score") % 1 == 0, F.col("score").cast("long").cast("string")).otherwise(F.col("score").cast("string"))
    attrs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(escape(e["key"], ";=&,"), F.lit("="), F.array_join(F.transform(e["value"], lambda v: escape(v, ";=&,")), ","))), ";")
    line = F.concat_ws("\t", escape(F.col("chr"), ">"), dot(F.col("source")), dot(F.col("type")), dot(F.col("start")), dot(F.col("end")), dot(score), dot(strand), dot(F.col("phase")), F.coalesce(F.nullif(attrs, F.lit("")), F.lit(".")))
    _write_lines(features.select(line.alias("value")), path, ["##gff-version 3"])


def read_wig(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """chr, start, end, value, format, span of variableStep, fixedStep and bedGraph data."""

    def parse(lines):
        kind = chrom = None
        at = step = span = 1
        for line in lines:
            f = line.split()
            if not f or f[0].startswith("#") or f[0] in ("browser", "track"):
                if f and f[0] == "track" and "bedGraph" in line:
                    kind = "bedGraph"
                continue
            if f[0] in ("variableStep", "fixedStep"):
                o = dict(x.split("=", 1) for x in f[1:])
                kind, chrom, span = f[0], o["chrom"], int(o.get("span", 1))
                at, step = int(o.get("start", 1)), int(o.get("step", 1))
            elif kind == "variableStep":
                yield chrom, int(f[0]), int(f[0]) + span - 1, float(f[1]), kind, span
            elif kind == "fixedStep":
                yield chrom, at, at + span - 1, float(f[0]), kind, span
                at += step
            else:
                yield f[0], int(f[1]) + 1, int(f[2]), float(f[3]), "bedGraph", int(f[2]) - int(f[1])

    d = _by_file(spark, path, parse, "chr string, start long, end long, value double, format string, span int")
    return d.withColumn("chr", regions.normalize_chromosome(F.col("chr"))) if normalize else d


def write_wig(values: DataFrame, path: str) -> None:
    """variableStep blocks of one chromosome and span, by position; a block a (chromosome, span, tile) task."""
    tile = F.floor(F.col("start") / 1_000_000)
    v = F.when(F.col("value") % 1 == 0, F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    rows = values.withColumn("_span", (F.col("end") - F.col("start") + 1)).withColumn("_t", tile).groupBy("chr", "_span", "_t").agg(F.array_sort(F.collect_list(F.struct("start", v.alias("v")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: F.concat(r["start"].cast("string"), F.lit(" "), r["v"])), "\n")
    line = F.concat(F.lit("variableStep chrom="), "chr", F.lit(" span="), F.col("_span").cast("string"), F.lit("\n"), body)
    _write_lines(rows.orderBy("chr", "_span", "_t").select(line.alias("value")), path)


# --- pileup text


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """rname, pos, ref, count, and pile array<struct<base,reverse,qual,starts,mapq,ends,inserted,deleted>>."""
    kind = "pile array<struct<base:string,reverse:boolean,qual:int,starts:boolean,mapq:int,ends:boolean,inserted:string,deleted:int>>"

    fields = StructType.fromDDL(f"rname string, pos int, ref string, count int, {kind}")
    target = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            lines = b.column("value").filter(pc.not_equal(b.column("value"), ""))
            if not len(lines):
                continue
            # lines of about PILES bytes at once: what becomes of a byte takes some fifty
            part = np.cumsum(pc.binary_length(lines).to_numpy()) // PILES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lines)]
            for i, k in zip(edges[:-1], edges[1:]):
                f = pc.split_pattern(lines.slice(i, k - i), "\t")
                rname, pos, ref, count, bases, quals = (pc.list_element(f, n) if n < 4 else _text_field(f, n) for n in range(6))
                count = count.cast(pa.int32())
                yield pa.RecordBatch.from_arrays([rname, pos.cast(pa.int32()), ref, count, pile_tokens(pc.if_else(pc.equal(count, 0), "", bases), quals, ref, target.field("pile").type)], schema=target)

    return spark.read.text(path).mapInArrow(run, fields)


def _text_field(fields: pa.ListArray, n: int) -> pa.Array:
    """The n-th field of each line; empty where a line has fewer."""
    long = pc.greater(pc.list_value_length(fields), n)
    if pc.all(long).as_py():
        return pc.list_element(fields, n)
    return pa.array([x[n] if len(x) > n else "" for x in fields.to_pylist()], pa.string())


#: bytes of pileup lines that are parsed at once
PILES = 1 << 20


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a text column."""
    lengths = pc.binary_length(column).to_numpy().astype(np.int64)
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8), lengths


def pile_tokens(bases: pa.Array, quals: pa.Array, ref: pa.Array, kind: pa.DataType) -> pa.ListArray:
    """The reads of each line's bases and qualities, of all lines at once."""
    x, lengths = _bytes_of(bases)
    q, q_lengths = _bytes_of(quals)
    n = len(x)
    line = np.repeat(np.arange(len(bases)), lengths)
    # a mark "^" and the quality after it, which may be a "^" too: every other one of a run is a mark
    caret = x == 94
    at = np.arange(n)
    fresh = caret & ~np.concatenate([[False], caret[:-1]])
    mark = caret & ((at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0)
    after = np.concatenate([[False], mark[:-1]])
    free = ~mark & ~after
    # "+" or "-", a number, and as many letters
    sign = np.flatnonzero(free & ((x == 43) | (x == 45)))
    size, end = np.zeros(len(sign), np.int64), sign + 1
    while True:
        more = (end < n) & (size >= 0)
        digit = np.where(more, x[np.minimum(end, max(n - 1, 0))], 0) if n else np.zeros(0, np.uint8)
        more &= (digit >= 48) & (digit <= 57) & (end - sign <= 9)
        if not more.any():
            break
        size, end = np.where(more, size * 10 + digit - 48, size), end + more
        done = ~more & (size >= 0)
        size[done] = -size[done] - 1  # the number has ended
    size = np.where(size < 0, -size - 1, size)
    taken = np.zeros(n + 1, np.int64)
    # a digit of one number may be a base of another only in a damaged line
    np.add.at(taken, sign, 1)
    np.add.at(taken, np.minimum(end + size, n), -1)
    free &= np.cumsum(taken[:-1]) == 0
    dollar = free & (x == 36)
    base = np.flatnonzero(free & ~dollar)
    b, own = x[base], line[base]
    k = np.cumsum(free & ~dollar) - 1  # the base that a place belongs to
    starts, ends = np.zeros(len(base), bool), np.zeros(len(base), bool)
    marks = np.flatnonzero(mark)
    mapq = np.zeros(len(base), np.int64)
    starts[k[marks] + 1] = True
    mapq[k[marks] + 1] = x[np.minimum(marks + 1, max(n - 1, 0))].astype(np.int64) - 33
    ends[k[np.flatnonzero(dollar)]] = True
    counts = np.bincount(own, minlength=len(bases))
    first = np.concatenate([[0], np.cumsum(counts)])
    if (counts > q_lengths).any():
        raise ValueError("a pileup line has fewer qualities than bases")
    quality = q[(np.concatenate([[0], np.cumsum(q_lengths)])[:-1])[own] + np.arange(len(base)) - first[own]].astype(np.int64) - 33
    lower = (b >= 97) & (b <= 122)
    upper = np.where(lower, b - 32, b)
    shown = pa.array(np.where((b == 60) | (b == 62), 62, upper), pa.uint8())
    letters = pa.array([chr(i) for i in range(128)]).take(shown)
    same = (b == 44) | (b == 46)
    if same.any():
        letters = pc.if_else(pa.array(same), pc.utf8_upper(ref).take(pa.array(own)), letters)
    deleted, inserted = np.zeros(len(base), np.int64), np.full(len(base), None, object)
    minus = x[sign] == 45
    deleted[k[sign[minus]]] = size[minus]
    has = np.zeros(len(base), bool)
    has[k[sign[minus]]] = True
    whole = x.tobytes()
    for i, a, m in zip(k[sign[~minus]].tolist(), end[~minus].tolist(), size[~minus].tolist()):
        inserted[i] = whole[a : a + m].decode().upper()
    parts = {
        "base": letters, "reverse": pa.array((b == 44) | (b == 60) | lower), "qual": pa.array(quality, pa.int32()), "starts": pa.array(starts), "mapq": pa.array(mapq, pa.int32(), mask=~starts),
        "ends": pa.array(ends), "inserted": pa.array(inserted, pa.string()), "deleted": pa.array(deleted, pa.int32(), mask=~has),
    }
    inner = kind.value_type
    rows = pa.StructArray.from_arrays([parts[inner.field(i).name].cast(inner.field(i).type) for i in range(inner.num_fields)], fields=list(inner))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows).cast(kind)


def write_pileup(text: DataFrame, path: str) -> None:
    """Rows of operators.pileup.pileup_text."""
    _write_lines(text.orderBy("rname", "pos").select(F.concat_ws("\t", "rname", F.col("pos").cast("string"), "ref", F.col("count").cast("string"), "bases", "quals").alias("value")), path)


# --- dispatch

EXTENSIONS = {
    "sam": "sam", "bam": "bam", "cram": "cram", "vcf": "vcf", "bcf": "bcf", "bed": "bed", "fa": "fasta", "fasta": "fasta",
    "fna": "fasta", "2bit": "2bit", "fq": "fastq", "fastq": "fastq", "gff": "gff3", "gff3": "gff3", "wig": "wig",
    "bw": "bigwig", "bigwig": "bigwig", "pileup": "pileup", "mpileup": "pileup", "bai": "bai", "csi": "csi", "tbi": "tbi",
    "crai": "crai", "fai": "fai", "gzi": "gzi", "dict": "dict",
}


def file_type(path: str) -> str | None:
    """Format by extension, a compression suffix aside."""
    name = re.sub(r"\.(gz|bgz|bz2)$", "", path.rstrip("/").lower())
    return EXTENSIONS.get(name.rsplit(".", 1)[-1])


def file_type_of(head: bytes) -> str | None:
    """Format by the first (uncompressed) bytes of a file."""
    for magic, kind in ((b"BAM\x01", "bam"), (b"CRAM", "cram"), (b"BCF\x02", "bcf"), (b"BAI\x01", "bai"), (b"CSI\x01", "csi"), (b"TBI\x01", "tbi"), (b"\x1aA'C", "2bit"), (b"C'A\x1a", "2bit"), (b"&\xfc\x8f\x88", "bigwig"), (b"\x88\x8f\xfc&", "bigwig"), (b"##fileformat=VCF", "vcf"), (b"##gff-version", "gff3")):
        if head.startswith(magic):
            return kind
    text = head.decode("utf-8", "replace")
    if re.match(r"@[A-Z][A-Z]\t[A-Z][A-Z]:", text):
        return "sam"
    if re.match(r"@[^\n]+\n[A-Za-z.*]+\n\+", text):
        return "fastq"
    if text.startswith(">"):
        return "fasta"
    if re.search(r"(?m)^(fixedStep|variableStep)\s", text):
        return "wig"
    return "bed" if re.match(r"(?m)(^(browser|track|#).*\n)*\S+[ \t]\d+[ \t]\d+", text) else None


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Reads by format (default: by extension)."""
    from . import convert

    return convert.read(spark, path, kind, **options)


def in_file_order(df: DataFrame) -> DataFrame:
    """Numbers rows from 0 in the order of `ordinal`: sorted by range, numbered by partition."""
    return numbered(df.orderBy("ordinal"), "_number").withColumn("ordinal", F.col("_number") - 1).drop("_number")
