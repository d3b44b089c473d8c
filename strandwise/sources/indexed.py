"""Indexes (CSI, TBI, FAI, GZI, CRAI) and BGZF text that is read by region or in splits.

A compressed text file is split at its blocks: a split begins at the first block after its byte offset, leaves out the
line that began before, and ends with the line that begins at or before its end. A region reads only the chunks that the
index names. Lines carry their virtual offsets, from which an index is built by aggregation.
"""

from __future__ import annotations

import gzip
import json
import os
import pickle
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .binary import BgzfReader, BgzfWriter, bgzf, write_parts

SPLIT = 64 << 20


# --- index files


def _bgzf_bytes(path: str) -> bytes:
    with gzip.open(path, "rb") as f:
        return f.read()


def tabix_aux(raw: bytes) -> dict:
    """format, columns (seq, beg, end), meta, skip and names of a tabix header."""
    kind, seq, beg, end, meta, skip, n = struct.unpack_from("<7i", raw)
    return {"format": kind, "columns": (seq, beg, end), "meta": chr(meta), "skip": skip, "names": [x.decode() for x in raw[28 : 28 + n].split(b"\0")[:-1]]}


def read_csi(raw: bytes) -> dict:
    """shift, depth, aux and, per reference, {bin: (least offset, chunks)}."""
    if raw[:4] != b"CSI\x01":
        raise ValueError("not a CSI file")
    shift, depth, n_aux = struct.unpack_from("<3i", raw, 4)
    aux, k = raw[16 : 16 + n_aux], 16 + n_aux
    n, k, refs = struct.unpack_from("<i", raw, k)[0], k + 4, []
    for _ in range(n):
        bins, m, k = {}, struct.unpack_from("<i", raw, k)[0], k + 4
        for _ in range(m):
            number, least, c = struct.unpack_from("<IQi", raw, k)
            flat = struct.unpack_from(f"<{2 * c}Q", raw, k + 16)
            bins[number] = (least, list(zip(flat[::2], flat[1::2])))
            k += 16 + 16 * c
        refs.append(bins)
    return {"shift": shift, "depth": depth, "aux": tabix_aux(aux) if len(aux) >= 28 else None, "refs": refs}


def read_tbi(raw: bytes) -> dict:
    """As `read_csi` gives it, from a tabix file; the least offsets come from the linear index."""
    if raw[:4] != b"TBI\x01":
        raise ValueError("not a tabix file")
    n = struct.unpack_from("<i", raw, 4)[0]
    aux = tabix_aux(raw[8:])
    k, refs = 36 + struct.unpack_from("<i", raw, 32)[0], []
    for _ in range(n):
        bins, m, k = {}, struct.unpack_from("<i", raw, k)[0], k + 4
        for _ in range(m):
            number, c = struct.unpack_from("<Ii", raw, k)
            flat = struct.unpack_from(f"<{2 * c}Q", raw, k + 8)
            bins[number] = list(zip(flat[::2], flat[1::2]))
            k += 8 + 16 * c
        m, k = struct.unpack_from("<i", raw, k)[0], k + 4
        linear = struct.unpack_from(f"<{m}Q", raw, k)
        k += 8 * m
        refs.append({b: (linear[min(_first(b, 5), len(linear) - 1)] if linear else 0, chunks) for b, chunks in bins.items()})
    return {"shift": 14, "depth": 5, "aux": aux, "refs": refs}


def _first(number: int, depth: int) -> int:
    """The first window of the finest level that a bin covers."""
    level, base = 0, 0
    while number >= base + 8**level and level < depth:
        base += 8**level
        level += 1
    return (number - base) << 3 * (depth - level)


def bins_of(start: int, end: int, shift: int, depth: int) -> list[int]:
    """All bins that a region (1-based, closed) may touch, coarse to fine."""
    out, base = [], 0
    end = min(end, 1 << shift + 3 * depth)
    for level in range(depth + 1):
        s = shift + 3 * (depth - level)
        out += range(base + (start - 1 >> s), base + (end - 1 >> s) + 1)
        base += 8**level
    return out


def region_chunks(index: dict, ref: int, start: int, end: int) -> list[tuple[int, int]]:
    """Merged chunks of a reference that may hold what overlaps a region (1-based, closed)."""
    bins, shift, depth = index["refs"][ref], index["shift"], index["depth"]
    # the least offset of the finest known bin that holds the start
    number, least = bins_of(start, start, shift, depth)[-1], 0
    while True:
        if number in bins:
            least = bins[number][0]
            break
        if not number:
            break
        number = number - 1 >> 3
    known = bins.keys() & set(bins_of(start, end, shift, depth))
    return merge_chunks([c for b in known for c in bins[b][1] if c[1] > least])


def merge_chunks(chunks, gap: int = 0) -> list[tuple[int, int]]:
    """Chunks in order, those that meet, or lie in one block or within `gap` compressed bytes, as one."""
    out: list[list[int]] = []
    for a, b in sorted(chunks):
        if out and (a >> 16) <= (out[-1][1] >> 16) + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def read_index(path: str) -> dict:
    raw = _bgzf_bytes(path)
    return read_csi(raw) if raw[:4] == b"CSI\x01" else read_tbi(raw)


def find_index(path: str) -> str | None:
    return next((path + x for x in (".csi", ".tbi") if os.path.exists(path + x)), None)


def read_fai(path: str) -> list[tuple[str, int, int, int, int]]:
    """(name, length, offset, bases a line, bytes a line)."""
    with open(path) as f:
        rows = [x.rstrip("\n").split("\t") for x in f if x.strip()]
    return [(r[0], *map(int, r[1:5])) for r in rows]


def read_gzi(path: str) -> list[tuple[int, int]]:
    """(compressed, uncompressed) offsets of blocks, the first one included."""
    with open(path, "rb") as f:
        raw = f.read()
    n = struct.unpack_from("<Q", raw)[0]
    flat = struct.unpack_from(f"<{2 * n}Q", raw, 8)
    return [(0, 0), *zip(flat[::2], flat[1::2])]


def write_gzi(path: str) -> None:
    """Builds the .gzi of a BGZF file from its block heads."""
    found, at, plain = [], 0, 0
    with open(path, "rb") as f:
        while head := f.read(18):
            size = struct.unpack_from("<H", head, 16)[0] + 1
            f.seek(at + size - 4)
            n = struct.unpack("<I", f.read(4))[0]
            at, plain = at + size, plain + n
            if n:
                found.append((at, plain))
    found = found[:-1]
    with open(path + ".gzi", "wb") as out:
        out.write(struct.pack("<Q", len(found)) + b"".join(struct.pack("<2Q", *x) for x in found))


def to_virtual(gzi: list[tuple[int, int]], offset: int) -> int:
    """Virtual offset of an uncompressed one."""
    import bisect

    k = bisect.bisect_right([u for _, u in gzi], offset) - 1
    return gzi[k][0] << 16 | offset - gzi[k][1]


def read_crai(path: str) -> list[tuple[int, int, int, int, int, int]]:
    """(reference, start, span, container offset, slice offset, slice size)."""
    return [tuple(map(int, x.split("\t"))) for x in _bgzf_bytes(path).decode().splitlines() if x]


def crai_entries(entries, ref: int, start: int, end: int) -> list[tuple]:
    """Entries that may hold what overlaps a region; each (container, slice) once."""
    hits = [e for e in entries if e[0] == ref and (e[1] <= end and e[1] + e[2] - 1 >= start)]
    return sorted(set(hits), key=lambda e: e[3:5])


# --- BGZF text


def lines_from(raw, offset: int) -> Iterator[tuple[bytes, int, int]]:
    """(line, its virtual offset, that of the next) from a virtual offset on."""
    src = BgzfReader(raw, offset)
    part, beg = b"", src.tell()
    while True:
        if src.at == len(src.data) and not src._block():
            if part:
                yield part, beg, src.tell()
            return
        if not part:
            beg = src.tell()
        cut = src.data.find(b"\n", src.at)
        if cut < 0:
            part, src.at = part + src.data[src.at :], len(src.data)
            continue
        line, src.at = part + src.data[src.at : cut], cut + 1
        part = b""
        yield line, beg, src.tell()
        beg = src.tell()


def next_block(raw, offset: int, size: int) -> int | None:
    """Where the first BGZF block at or after a byte offset begins: a head whose block is followed by another, or by the end."""
    at = offset
    while at < size:
        raw.seek(at)
        window = raw.read(1 << 17)
        k = window.find(b"\x1f\x8b\x08\x04")
        while k >= 0:
            head = window[k : k + 18]
            if len(head) == 18 and head[12:16] == b"BC\x02\x00":
                after = at + k + struct.unpack_from("<H", head, 16)[0] + 1
                raw.seek(after)
                if after == size or raw.read(4) == b"\x1f\x8b\x08\x04":
                    return at + k
            k = window.find(b"\x1f\x8b\x08\x04", k + 1)
        if len(window) < 18:
            return None
        at += len(window) - 17
    return None


class _Span(InputPartition):
    def __init__(self, beg: int, end: int, split: bool):
        super().__init__((beg, end, split))
        self.beg, self.end, self.split = beg, end, split


_LINES = pa.schema([("value", pa.string()), ("beg", pa.int64()), ("next", pa.int64())])


class _LinesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.spans = options["path"], options.get("spans")
        self.split = int(options.get("split", SPLIT))

    def partitions(self):
        if self.spans is not None:
            return [_Span(a, b, False) for a, b in json.loads(self.spans)] or [_Span(0, 0, False)]
        size = os.path.getsize(self.path)
        return [_Span(a, min(a + self.split, size), True) for a in range(0, max(size, 1), self.split)]

    def read(self, partition):
        beg, end = partition.beg, partition.end
        held: list[tuple] = []
        with open(self.path, "rb") as raw:
            if partition.split:
                size = os.path.getsize(self.path)
                first, last = next_block(raw, beg, size), next_block(raw, end, size) if end < size else None
                if first is None or first == last:
                    return
                rows = lines_from(raw, first << 16)
                if beg:
                    next(rows, None)  # the split before has it
                # a line that begins where the next split does is this one's
                inside = (lambda at: True) if last is None else (lambda at: at <= last << 16)
            else:
                rows, inside = lines_from(raw, beg), lambda at: at < end
            for line, at, after in rows if end > beg else ():
                if not inside(at):
                    break
                held.append((line.rstrip(b"\r").decode(), at, after))
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _LINES.types)], schema=_LINES)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _LINES.types)], schema=_LINES)


class LinesSource(DataSource):
    """format("bgzf_lines"): value, beg and next (virtual offsets); options path, spans (JSON of virtual offsets), split (bytes)."""

    @classmethod
    def name(cls):
        return "bgzf_lines"

    def schema(self):
        return "value string, beg long, next long"

    def reader(self, schema):
        return _LinesReader(self.options)


def read_lines(spark: SparkSession, path: str, spans=None, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(LinesSource)
    r = spark.read.format("bgzf_lines").option("path", path).option("split", str(split))
    return (r.option("spans", json.dumps(spans)) if spans is not None else r).load()


def write_bgzf(data: bytes, path: str) -> None:
    with open(path, "wb") as out:
        w = BgzfWriter(out)
        w.write(data)
        w.close()


def read_vcf_region(spark: SparkSession, path: str, chr: str, start: int = 1, end: int = (1 << 31) - 1, index: str | None = None) -> DataFrame:  # noqa: A002
    """Variants of a BGZF VCF that overlap a region, from the chunks that its CSI or tabix index names."""
    from ..operators.variants import in_region
    from . import text

    meta, found = text.read_vcf_meta(spark, path), read_index(index or find_index(path))
    names = found["aux"]["names"] if found["aux"] else [x["id"] for x in meta.get("contig", [])]
    spans = region_chunks(found, names.index(chr), start, end) if chr in names else []
    rows = text.vcf_rows(read_lines(spark, path, spans).withColumn("ordinal", F.col("beg")), meta)
    last = F.coalesce(F.get(F.col("info")["END"], F.lit(0)).try_cast("long"), F.col("pos") + F.length("ref") - 1)
    return in_region(rows.withColumn("_last", last), chr, end=end).where(F.col("_last") >= start).drop("_last")


def write_vcf_bgzf(variants: DataFrame, path: str, meta: dict, index: bool = False) -> None:
    """One BGZF VCF file of variants in their order, and its CSI index; tasks compress the parts."""
    from . import text

    rows = variants.select(text.vcf_line(meta.get("columns", [])[9:]).alias("value"))
    head = "".join(x + "\n" for x in text.format_meta(meta)).encode()
    write_parts(rows, lambda batches: (bgzf(b"".join(x.encode() + b"\n" for b in batches for x in b.column("value").to_pylist())), b""), path, bgzf(head))
    if index:
        build_vcf_index(variants.sparkSession, path)


# --- building


def _bin_column(start: Column, end: Column, shift: int, depth: int) -> Column:
    """The finest bin that holds an interval (1-based, closed)."""
    out, base = F.lit(0).cast("long"), 0
    for level in range(depth + 1):
        s = shift + 3 * (depth - level)
        first = F.shiftright(start.cast("long") - 1, s)
        out = F.when(first == F.shiftright(end.cast("long") - 1, s), F.lit(base) + first).otherwise(out)
        base += 8**level
    return out


def index_rows(records: DataFrame, shift: int = 14, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(ref, bin, beg, next: chunks; ref, window, least: the linear index) of records (ref, start, end, beg, next).

    Chunks of a bin that meet in a block are one. What is left is a row a chunk and a row a window, as the index has it.
    """
    b = records.withColumn("bin", _bin_column(F.col("start"), F.col("end"), shift, depth))
    order = Window.partitionBy("ref", "bin").orderBy("beg")
    new = F.when(F.shiftright("beg", 16) <= F.shiftright(F.lag("next").over(order), 16), 0).otherwise(1)
    part = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    chunks = b.withColumn("_new", new).withColumn("_part", part).groupBy("ref", "bin", "_part").agg(F.min("beg").alias("beg"), F.max("next").alias("next")).drop("_part")
    windows = records.select("ref", "beg", F.explode(F.sequence(F.shiftright(F.col("start").cast("long") - 1, shift), F.shiftright(F.col("end").cast("long") - 1, shift))).alias("window"))
    return chunks, windows.groupBy("ref", "window").agg(F.min("beg").alias("least"))


def csi_bytes(chunks, windows, refs: int, shift: int = 14, depth: int = 5, aux: bytes = b"") -> bytes:
    """A CSI file from an index's rows, which come to the driver as one file holds them all."""
    by: list[dict[int, list]] = [{} for _ in range(refs)]
    for r in chunks.collect():
        by[r["ref"]].setdefault(r["bin"], []).append((r["beg"], r["next"]))
    least: list[dict[int, int]] = [{} for _ in range(refs)]
    for r in windows.collect():
        least[r["ref"]][r["window"]] = r["least"]
    out = b"CSI\x01" + struct.pack("<3i", shift, depth, len(aux)) + aux + struct.pack("<i", refs)
    for bins, linear in zip(by, least):
        known = sorted(linear)
        out += struct.pack("<i", len(bins))
        for number, found in sorted(bins.items()):
            out += struct.pack("<IQi", number, _least(known, linear, _first(number, depth)), len(found)) + b"".join(struct.pack("<2Q", *c) for c in sorted(found))
    return out


def _least(known: list[int], linear: dict[int, int], window: int) -> int:
    import bisect

    k = bisect.bisect_right(known, window) - 1
    return linear[known[max(k, 0)]] if known else 0


def build_vcf_index(spark: SparkSession, path: str, out: str | None = None, shift: int = 14, depth: int = 5) -> str:
    """Builds the CSI index of a BGZF VCF; names stand in the order in which the file has them."""
    from . import text

    lines = read_lines(spark, path).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    v = text.vcf_rows(lines.withColumn("ordinal", F.col("beg")).withColumn("after", F.col("next")), {"columns": []}, keep=("after",))
    last = F.greatest(F.coalesce(F.get(F.col("info")["END"], F.lit(0)).try_cast("long"), F.col("pos") + F.length("ref") - 1), F.col("pos"))
    names = [r["chr"] for r in v.groupBy("chr").agg(F.min("ordinal").alias("o")).orderBy("o").collect()]
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.create_map().cast("map<string,int>")
    chunks, windows = index_rows(v.select(number[F.col("chr")].alias("ref"), F.greatest("pos", F.lit(1)).alias("start"), F.greatest(last, F.lit(1)).alias("end"), F.col("ordinal").alias("beg"), F.col("after").alias("next")), shift, depth)
    joined = b"".join(n.encode() + b"\0" for n in names)
    aux = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(joined)) + joined
    out = out or path + ".csi"
    write_bgzf(csi_bytes(chunks, windows, len(names), shift, depth, aux), out)
    return out


def build_bai(spark: SparkSession, path: str) -> str:
    """Builds the BAI of a BAM file sorted by coordinate, from its records' places alone."""
    from .binary import BaiBuilder, BgzfReader, read_bam, read_bam_header

    with open(path, "rb") as raw:
        names = [n for n, _ in read_bam_header(BgzfReader(raw))[1]]
    ids = {n: i for i, n in enumerate(names)}

    def run(batches):
        """The index of a split's records, which are in order; the file is read once."""
        first, builder = None, BaiBuilder(len(names))
        for b in batches:
            columns = [b.column(n).to_pylist() for n in ("rname", "pos", "end", "flag", "ordinal", "next")]
            for rname, pos, end, flag, beg, after in zip(*columns):
                first = beg if first is None else first
                builder.add(ids.get(rname, -1), pos, end, flag, beg, after)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([pickle.dumps(builder)], pa.binary())], names=["first", "part"])

    whole = BaiBuilder(len(names))
    for _, part in sorted((r["first"], bytes(r["part"])) for r in read_bam(spark, path, columns="pointer").mapInArrow(run, "first long, part binary").collect()):
        whole.append(pickle.loads(part), 0)
    with open(path + ".bai", "wb") as f:
        f.write(whole.to_bytes())
    return path + ".bai"


# --- FASTA by index


def read_fasta_region(path: str, chr: str, start: int = 1, end: int | None = None, mask: bool = False) -> str | None:  # noqa: A002
    """Bases of a region by seeking with the .fai (and .gzi, if the file is BGZF); clamped, null for an unknown name."""
    found = {r[0]: r for r in read_fai(path + ".fai")}
    if chr not in found:
        return None
    _, length, offset, bases, width = found[chr]
    start, end = max(start, 1), length if end is None else min(end, length)
    if start > end:
        return None
    at = lambda p: offset + (p - 1) // bases * width + (p - 1) % bases
    first, last = at(start), at(end) + 1
    with open(path, "rb") as raw:
        if path.endswith((".gz", ".bgz")):
            data = BgzfReader(raw, to_virtual(read_gzi(path + ".gzi"), first)).read(last - first)
        else:
            raw.seek(first)
            data = raw.read(last - first)
    text = data.replace(b"\n", b"").replace(b"\r", b"").decode()
    return text if mask else text.upper()


def fasta_chunks(spark: SparkSession, path: str, mask: bool = False, width: int = 1 << 16) -> DataFrame:
    """(name, chunk, bases) of an indexed FASTA file: each task seeks to its chunks, so one sequence is many tasks."""
    rows = [(n, length) for n, length, *_ in read_fai(path + ".fai")]
    asked = spark.createDataFrame(rows, "name string, len long").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("len") / width), F.lit(1)) - 1)))

    def run(batches):
        for b in batches:
            names, chunks = b.column("name").to_pylist(), b.column("chunk").to_pylist()
            bases = [read_fasta_region(path, n, c * width + 1, (c + 1) * width, mask) or "" for n, c in zip(names, chunks)]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(chunks, pa.int32()), pa.array(bases, pa.string())], names=["name", "chunk", "bases"])

    return asked.select("name", "chunk").repartition(F.col("name"), F.col("chunk")).mapInArrow(run, "name string, chunk int, bases string")
