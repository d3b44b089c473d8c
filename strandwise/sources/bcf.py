"""BCF 2.2 as a data source and a writer.

Records are decoded to the fields of a VCF line, and go through the same expressions; so a BCF table has the columns of a
VCF one. With a CSI index a region reads only the chunks that it names. Files are written in parts by tasks.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..storage import checkpoint
from . import text
from .binary import BgzfReader, bgzf, first_record, write_parts
from .indexed import _LINES, SPLIT, _Span, find_index, read_index, region_chunks

MAGIC = b"BCF\x02\x02"
_INTS = {1: ("b", 1, -128, -127), 2: ("h", 2, -32768, -32767), 3: ("i", 4, -(2**31), -(2**31) + 1)}
_MISSING, _END = 0x7F800001, 0x7F800002


def dictionaries(meta_lines: list[str]) -> tuple[list[str], list[str]]:
    """(strings of FILTER, INFO and FORMAT with PASS first, contigs) in the order of their numbers; IDX overrides it."""
    strings, contigs = {"PASS": 0}, {}
    for line in meta_lines:
        m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<(.*)>", line)
        if not m:
            continue
        fields = {k: v for k, v in text.META.findall(m.group(2))}
        into = contigs if m.group(1) == "contig" else strings
        if fields["ID"] not in into:
            into[fields["ID"]] = int(fields["IDX"]) if "IDX" in fields else max(into.values(), default=-1) + 1
    place = lambda d: [next((k for k, v in d.items() if v == i), None) for i in range(max(d.values(), default=-1) + 1)]
    return place(strings), place(contigs)


def read_header(src: BgzfReader) -> list[str]:
    if src.read(5) != MAGIC:
        raise ValueError("not a BCF 2.2 file")
    raw = src.read(struct.unpack("<I", src.read(4))[0])
    if not raw or raw[-1]:
        raise ValueError("a BCF header ends with a zero byte")
    return raw[:-1].decode().splitlines()


def genotype_to_ints(gt: str | None) -> list[int]:
    """Alleles as BCF has them: (allele + 1) * 2, plus one if phased; the first never is."""
    found = re.findall(r"([/|]?)(\d+|\.)", gt or ".")
    return [((0 if a == "." else int(a) + 1) << 1) | (i > 0 and s == "|") for i, (s, a) in enumerate(found)]


def ints_to_genotype(values) -> str | None:
    out = "".join(("|" if v & 1 else "/") + ("." if v < 2 else str((v >> 1) - 1)) for v in values)[1:]
    return out if out not in ("", ".") else None


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1 << 23 else f"{x:.7g}"


def _typed(data: bytes, k: int):
    """(type, count, place of the values)."""
    kind, n, k = data[k] & 15, data[k] >> 4, k + 1
    if n == 15:
        _, _, at = _typed(data, k)
        n, k = _ints(data, at, data[k] & 15, 1)[0], at + _INTS[data[k] & 15][1]
    return kind, n, k


def _ints(data: bytes, k: int, kind: int, n: int) -> list[int]:
    fmt, size, *_ = _INTS[kind]
    return list(struct.unpack_from(f"<{n}{fmt}", data, k))


def _values(data: bytes, k: int, kind: int, n: int) -> tuple[list, int]:
    """(values with None where missing and without what comes after the end mark, next place)."""
    if kind == 0:
        return [], k
    if kind == 7:
        raw = data[k : k + n].split(b"\0")[0].decode()
        return raw.split(",") if raw else [], k + n
    if kind == 5:
        bits = struct.unpack_from(f"<{n}I", data, k)
        xs = struct.unpack_from(f"<{n}f", data, k)
        return [None if b == _MISSING else _number(x) for b, x in zip(bits, xs) if b != _END], k + 4 * n
    _, size, missing, end = _INTS[kind]
    return [None if x == missing else x for x in _ints(data, k, kind, n) if x != end], k + n * size


def _shown(values) -> str:
    return ",".join("." if v is None else str(v) for v in values) or "."


def decode(shared: bytes, each: bytes, strings: list[str], contigs: list[str]) -> str:
    """The line of a record."""
    chrom, pos, rlen, qual, n_allele_info, n_fmt_sample = struct.unpack_from("<3i3I", shared)
    n_info, n_allele, n_sample, n_fmt = n_allele_info & 0xFFFF, n_allele_info >> 16, n_fmt_sample & 0xFFFFFF, n_fmt_sample >> 24
    k, names = 24, []
    for _ in range(1 + n_allele):
        _, n, k = _typed(shared, k)
        names.append(shared[k : k + n].decode())
        k += n
    kind, n, k = _typed(shared, k)
    filters, k = _values(shared, k, kind, n)
    info = []
    for _ in range(n_info):
        kind, n, k = _typed(shared, k)
        key, k = strings[_ints(shared, k, kind, 1)[0]], k + _INTS[kind][1]
        kind, n, k = _typed(shared, k)
        values, k = _values(shared, k, kind, n)
        info.append(key if not values and kind == 0 else f"{key}={_shown(values)}")
    quality = "." if qual == _MISSING else _number(struct.unpack("<f", struct.pack("<I", qual))[0])
    line = [contigs[chrom], str(pos + 1), names[0] or ".", names[1], ",".join(names[2:]) or ".", quality, ";".join(strings[f] for f in filters) or ".", ";".join(info) or "."]
    if n_sample:
        keys, columns, k = [], [], 0
        for _ in range(n_fmt):
            kind, n, k = _typed(each, k)
            keys.append(strings[_ints(each, k, kind, 1)[0]])
            kind, n, k = _typed(each, k + _INTS[kind][1])
            column = []
            for _ in range(n_sample):
                values, k = _values(each, k, kind, n)
                column.append((ints_to_genotype([v or 0 for v in values]) or ".") if keys[-1] == "GT" else _shown(values))
            columns.append(column)
        line.append(":".join(keys))
        line += [":".join(c[s] for c in columns) for s in range(n_sample)]
    return "\t".join(line)


def _plausible(data: bytes, k: int, contigs: int, samples: int) -> int | None:
    """Where the record at k ends, if it may be one."""
    if k + 33 > len(data):
        return None
    shared, each, chrom, pos, rlen, _, n_allele_info, n_fmt_sample = struct.unpack_from("<2I3i3I", data, k)
    if not (25 <= shared < 1 << 28 and each < 1 << 28 and 0 <= chrom < contigs and pos >= -1 and rlen >= 0 and n_allele_info >> 16 and n_fmt_sample & 0xFFFFFF == samples):
        return None
    # the identifier comes next, a text or nothing
    return k + 8 + shared + each if data[k + 32] & 15 in (0, 7) and (each or not n_fmt_sample >> 24) else None


def _samples(header: list[str]) -> int:
    return max(0, len(next((x for x in header if x.startswith("#CHROM")), "").split("\t")) - 9)


#: a record's place: number of its contig, first and last base, virtual offsets of it and of the one after it
_PLACES = pa.schema([("ref", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("beg", pa.int64()), ("next", pa.int64())])


class _BcfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.spans = options["path"], options.get("spans")
        self.split, self.places = int(options.get("split", SPLIT >> 4)), options.get("places") == "true"

    def partitions(self):
        if self.spans is not None:
            return [_Span(a, b, False) for a, b in json.loads(self.spans)] or [_Span(0, 0, False)]
        with open(self.path, "rb") as raw:
            src = BgzfReader(raw)
            read_header(src)
            first = src.tell()
        index = find_index(self.path)
        if index is None:
            size = os.path.getsize(self.path)
            return [_Span(a, min(a + self.split, size), True) for a in range(0, size, self.split)]
        # an index names places at which records begin
        cuts = sorted({first, *(least for bins in read_index(index)["refs"] for least, _ in bins.values() if least > first)})
        cuts = cuts[:: max(1, len(cuts) // 64)]
        return [_Span(a, b, False) for a, b in zip(cuts, [*cuts[1:], 1 << 62])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = _PLACES if self.places else _LINES
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
        with open(self.path, "rb") as raw:
            src = BgzfReader(raw)
            header = read_header(src)
            strings, contigs = dictionaries(header)
            beg, end = partition.beg, partition.end
            if partition.split:  # a range of bytes, which begins at the first place from which a chain of plausible records goes on
                size, n = os.path.getsize(self.path), _samples(header)
                find = lambda at: first_record(raw, at, size, 0, plausible=lambda data, k: _plausible(data, k, len(contigs), n))
                beg, end = find(beg) if beg else src.tell(), find(end) if end < size else 1 << 62
                if beg is None:
                    return
                end = 1 << 62 if end is None else end
            src = BgzfReader(raw, beg)
            while src.tell() < end:
                at = src.tell()
                head = src.read(8)
                if len(head) < 8:
                    break
                a, b = struct.unpack("<2I", head)
                shared, each = src.read(a), src.read(b)
                if self.places:
                    chrom, pos, rlen = struct.unpack_from("<3i", shared)
                    start = max(pos + 1, 1)
                    held.append((chrom, start, max(pos + rlen, start), at, src.tell()))
                else:
                    held.append((decode(shared, each, strings, contigs), at, src.tell()))
                if len(held) == 5000:
                    yield batch()
                    held = []
        if held:
            yield batch()


class BcfSource(DataSource):
    """format("bcf"): value (a record as a VCF line), beg and next (virtual offsets); options path, spans, split (bytes).

    With places=true, ref, start, end, beg and next instead: where a record lies, without its fields.
    """

    @classmethod
    def name(cls):
        return "bcf"

    def schema(self):
        return "ref int, start long, end long, beg long, next long" if self.options.get("places") == "true" else "value string, beg long, next long"

    def reader(self, schema):
        return _BcfReader(self.options)


def bcf_meta(path: str) -> dict:
    with open(path, "rb") as raw:
        return text.parse_meta(read_header(BgzfReader(raw)))


def read_bcf(spark: SparkSession, path: str, chr: str | None = None, start: int = 1, end: int = (1 << 31) - 1) -> DataFrame:  # noqa: A002
    """Variants as `read_vcf` gives them; a region is read by the CSI index beside the file, if there is one."""
    spark.dataSource.register(BcfSource)
    meta = bcf_meta(path)
    r = spark.read.format("bcf").option("path", path)
    index = find_index(path)
    if chr is not None and index is not None:
        with open(path, "rb") as raw:
            contigs = dictionaries(read_header(BgzfReader(raw)))[1]
        found = read_index(index)
        known = chr in contigs and contigs.index(chr) < len(found["refs"])
        r = r.option("spans", json.dumps(region_chunks(found, contigs.index(chr), start, end) if known else []))
    rows = text.vcf_rows(r.load().withColumn("ordinal", F.col("beg")), meta, keep=("next",))
    if chr is None:
        return rows.drop("next")
    last = F.coalesce(F.get(F.col("info")["END"], F.lit(0)).try_cast("long"), F.col("pos") + F.length("ref") - 1)
    return rows.where((F.col("chr") == chr) & (F.col("pos") <= end) & (last >= start)).drop("next")


def build_bcf_index(spark: SparkSession, path: str) -> str:
    """Builds the CSI index of a BCF file; its references are the header's contigs."""
    from .indexed import csi_bytes, index_rows, write_bgzf

    spark.dataSource.register(BcfSource)
    with open(path, "rb") as raw:
        contigs = dictionaries(read_header(BgzfReader(raw)))[1]
    if os.path.exists(path + ".csi"):
        os.remove(path + ".csi")
    # rows of five numbers, kept for the two tables that are made of them
    chunks, windows = index_rows(checkpoint(spark.read.format("bcf").option("path", path).option("places", "true").load()))
    write_bgzf(csi_bytes(chunks, windows, len(contigs)), path + ".csi")
    return path + ".csi"


# --- writing


def _size(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _int_vector([n])


def _int_kind(values) -> int:
    xs = [v for v in values if v is not None]
    lo, hi = min(xs, default=0), max(xs, default=0)
    return 1 if lo >= -120 and hi <= 127 else 2 if lo >= -32760 and hi <= 32767 else 3


def _pack_ints(values, kind: int, n: int) -> bytes:
    fmt, _, missing, end = _INTS[kind]
    return struct.pack(f"<{n}{fmt}", *[missing if v is None else v for v in values], *[end] * (n - len(values)))


def _pack_floats(values, n: int) -> bytes:
    return b"".join(struct.pack("<I", _MISSING) if v is None else struct.pack("<f", v) for v in values) + struct.pack("<I", _END) * (n - len(values))


def _int_vector(values) -> bytes:
    kind = _int_kind(values)
    return _size(kind, len(values)) + _pack_ints(values, kind, len(values))


def _string(x: str) -> bytes:
    raw = x.encode()
    return _size(7, len(raw)) + raw


def _parts(x: str, kind: str) -> list:
    conv = {"Integer": int, "Float": float}.get(kind, str)
    return [None if v in (".", "") else conv(v) for v in x.split(",")]


def encode(line: str, types: dict, strings: dict[str, int], contigs: dict[str, int], samples: int) -> bytes:
    f = line.split("\t")
    alts = [] if f[4] == "." else f[4].split(",")
    info = [] if f[7] == "." else [x.partition("=") for x in f[7].split(";")]
    stop = next((int(v) for k, _, v in info if k == "END" and v.isdigit()), None)
    rlen = len(f[3]) if stop is None else stop - int(f[1]) + 1
    quality = struct.pack("<I", _MISSING) if f[5] == "." else struct.pack("<f", float(f[5]))
    keys = f[8].split(":") if samples and len(f) > 8 and f[8] != "." else []
    shared = struct.pack("<3i", contigs[f[0]], int(f[1]) - 1, rlen) + quality
    shared += struct.pack("<2I", (1 + len(alts)) << 16 | len(info), len(keys) << 24 | samples)
    shared += _string("" if f[2] == "." else f[2]) + b"".join(map(_string, [f[3], *alts]))
    shared += _int_vector([strings[x] for x in f[6].split(";")]) if f[6] != "." else _size(0, 0)
    for k, sep, v in info:
        kind = types["info"].get(k, "String")
        shared += _int_vector([strings[k]])
        if not sep or kind == "Flag":
            shared += _size(0, 0)
        elif kind == "Integer":
            shared += _int_vector(_parts(v, kind))
        elif kind == "Float":
            shared += _size(5, len(v.split(","))) + _pack_floats(_parts(v, kind), len(v.split(",")))
        else:
            shared += _string(v)
    each = b""
    for i, k in enumerate(keys):
        raw = [(s.split(":") + ["."] * len(keys))[i] for s in f[9:]]
        kind = types["format"].get(k, "String")
        each += _int_vector([strings[k]])
        if k == "GT" or kind == "Integer":
            values = [genotype_to_ints(x) if k == "GT" else _parts(x, kind) for x in raw]
            n, own = max(map(len, values)), _int_kind([v for x in values for v in x])
            each += _size(own, n) + b"".join(_pack_ints(v, own, n) for v in values)
        elif kind == "Float":
            values = [_parts(x, kind) for x in raw]
            n = max(map(len, values))
            each += _size(5, n) + b"".join(_pack_floats(v, n) for v in values)
        else:
            n = max(len(x.encode()) for x in raw)
            each += _size(7, n) + b"".join(x.encode().ljust(n, b"\0") for x in raw)
    return struct.pack("<2I", len(shared), len(each)) + shared + each


def write_bcf(variants: DataFrame, path: str, meta: dict) -> None:
    """One BCF file from variants as `read_vcf` gives them, in their order; names must be declared in the meta-information."""
    samples = meta.get("columns", [])[9:]
    lines = text.format_meta(meta)
    strings, contigs = ({n: i for i, n in enumerate(d) if n is not None} for d in dictionaries(lines))
    types = {k: {x["id"]: x["type"] for x in meta.get(k, [])} for k in ("info", "format")}
    raw = ("\n".join(lines) + "\n").encode() + b"\0"

    def run(batches):
        data = b"".join(encode(x, types, strings, contigs, len(samples)) for b in batches for x in b.column("value").to_pylist())
        return bgzf(data), b""

    write_parts(variants.select(text.vcf_line(samples).alias("value")), run, path, bgzf(MAGIC + struct.pack("<I", len(raw)) + raw))
