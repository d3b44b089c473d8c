"""BGZF, BAM with its BAI index, and 2bit, as Python data sources and codecs.

A BAM file is split at the record starts that its linear index names, when it has one; otherwise by byte ranges, each of
which begins at the first place from which a chain of plausible records goes on. A region prunes by the index; the
residual test stays in the source. Files are written in parts by tasks, which are then put together byte by byte.
"""

from __future__ import annotations

import io
import os
import pickle
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import Folder

EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
_NIBBLES = str.maketrans("0123456789abcdef", BASES)
_PLUS33 = bytes((i + 33) & 255 for i in range(256))
BAM_SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, options array<struct<tag:string,type:string,value:string>>, end int, ordinal long"

_STRINGS, _INTS = ("qname", "rname", "cigar", "rnext", "seq", "qual"), ("flag", "pos", "mapq", "pnext", "tlen", "end")
BAM_ARROW = pa.schema(
    [
        (name, pa.string() if name in _STRINGS else pa.int32() if name in _INTS else pa.int64() if name == "ordinal" else pa.list_(pa.struct([("tag", pa.string()), ("type", pa.string()), ("value", pa.string())])))
        for name in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "options", "end", "ordinal")
    ]
)

BAM_NEXT = BAM_ARROW.append(pa.field("next", pa.int64()))


def compress_block(data: bytes, level: int = 6) -> bytes:
    """One BGZF block of at most 65280 bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


class BgzfWriter:
    """Blocks of compressed data; tell() is the virtual offset of the next byte."""

    def __init__(self, out):
        self.out, self.buffer, self.at = out, bytearray(), 0

    def tell(self) -> int:
        return self.at << 16 | len(self.buffer)

    def write(self, data: bytes) -> None:
        self.buffer += data
        while len(self.buffer) >= 65280:
            self._flush(65280)

    def _flush(self, n: int) -> None:
        block = compress_block(bytes(self.buffer[:n]))
        self.out.write(block)
        self.at += len(block)
        del self.buffer[:n]

    def close(self) -> None:
        if self.buffer:
            self._flush(len(self.buffer))
        self.out.write(EOF_BLOCK)


class BgzfReader:
    """Reads decompressed bytes from a virtual offset on; plain gzip isn't accepted."""

    def __init__(self, raw, offset: int = 0):
        self.raw = raw
        raw.seek(offset >> 16)
        self.data, self.at, self.start, self.next = b"", 0, offset >> 16, offset >> 16
        if offset & 0xFFFF:
            self._block()
            self.at = offset & 0xFFFF

    def tell(self) -> int:
        return self.next << 16 if self.at == len(self.data) else self.start << 16 | self.at

    def _block(self) -> bool:
        head = self.raw.read(12)
        if len(head) < 12:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = self.raw.read(struct.unpack("<H", head[10:])[0])
        size, k = None, 0
        while k < len(extra):
            a, b, n = struct.unpack_from("<2BH", extra, k)
            if (a, b) == (66, 67):
                size = struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        if size is None:
            raise ValueError("not a BGZF block")
        body = self.raw.read(size - 12 - len(extra))
        data = zlib.decompress(body[:-8], -15)
        if struct.unpack("<2I", body[-8:]) != (zlib.crc32(data), len(data)):
            raise ValueError("a BGZF block is damaged")
        self.start, self.next, self.data, self.at = self.next, self.next + size, data, 0
        return True

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at == len(self.data) and not self._block():
                return out
            take = self.data[self.at : self.at + n - len(out)]
            self.at += len(take)
            out += take
        return out


def read_bam_header(src: BgzfReader) -> tuple[str, list[tuple[str, int]]]:
    if src.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = src.read(struct.unpack("<i", src.read(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", src.read(4))[0]):
        name = src.read(struct.unpack("<i", src.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", src.read(4))[0]))
    return text, refs


_KINDS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _number(kind: str, x) -> str:
    return f"{x:.9g}" if kind == "f" else str(x)


def _options(data: bytes) -> list[dict]:
    out, k = [], 0
    while k < len(data):
        tag, kind = data[k : k + 2].decode(), chr(data[k + 2])
        k += 3
        if kind in "ZH":
            e = data.index(0, k)
            value, k = data[k:e].decode(), e + 1
        elif kind == "A":
            value, k = chr(data[k]), k + 1
        elif kind == "B":
            sub, n = chr(data[k]), struct.unpack_from("<i", data, k + 1)[0]
            fmt = f"<{n}{_KINDS[sub]}"
            value, k = ",".join([sub, *(_number(sub, x) for x in struct.unpack_from(fmt, data, k + 5))]), k + 5 + struct.calcsize(fmt)
        else:
            fmt = "<" + _KINDS[kind]
            value = _number(kind, struct.unpack_from(fmt, data, k)[0])
            k, kind = k + struct.calcsize(fmt), kind if kind == "f" else "i"
        out.append({"tag": tag, "type": kind, "value": value})
    return out


def _encode_options(options) -> bytes:
    out = b""
    for o in options or []:
        tag, kind, value = o["tag"].encode(), o["type"], o["value"]
        if kind in "ZH":
            body = kind.encode() + value.encode() + b"\0"
        elif kind == "A":
            body = b"A" + value.encode()
        elif kind == "B":
            sub, *xs = value.split(",")
            conv = float if sub == "f" else int
            body = b"B" + sub.encode() + struct.pack(f"<i{len(xs)}{_KINDS[sub]}", len(xs), *map(conv, xs))
        elif kind == "f":
            body = b"f" + struct.pack("<f", float(value))
        else:
            x = int(value)
            k = next(k for k in "cCsSiI" if -(1 << (8 * struct.calcsize(_KINDS[k]) - 1)) * (k.islower()) <= x < 1 << (8 * struct.calcsize(_KINDS[k]) - k.islower()))
            body = k.encode() + struct.pack("<" + _KINDS[k], x)
        out += tag + body
    return out


def region_bin(beg: int, end: int) -> int:
    """Bin of a 0-based half-open interval."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return first + (beg >> shift)
    return 0


def encode_record(r: dict, ids: dict[str, int]) -> bytes:
    ops = [(int(n), o) for n, o in _cigar(r["cigar"])]
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    name, seq = r["qname"].encode() + b"\0", "" if r["seq"] == "*" else r["seq"]
    options = list(r.get("options") or [])
    if len(ops) > 65535:  # too long for the record: a placeholder, and the operations in a tag
        options.append({"tag": "CG", "type": "B", "value": ",".join(["I", *(str(n << 4 | OPS.index(o)) for n, o in ops)])})
        ops = [(len(seq), "S"), (span, "N")]
    packed = bytes((BASES.index(a.upper()) << 4) | (BASES.index(b.upper()) if b else 0) for a, b in zip(seq[::2], [*seq[1::2], ""][: len(seq[::2])]))
    qual = b"\xff" * len(seq) if r["qual"] == "*" else bytes(ord(q) - 33 for q in r["qual"])
    ref = ids.get(r["rname"], -1)
    nref = ref if r["rnext"] == "=" else ids.get(r["rnext"], -1)
    body = struct.pack("<2i2B3H4i", ref, r["pos"] - 1, len(name), r["mapq"], region_bin(max(r["pos"] - 1, 0), max(r["pos"] - 1, 0) + span), len(ops), r["flag"], len(seq), nref, r["pnext"] - 1, r["tlen"])
    body += name + b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in ops) + packed + qual + _encode_options(options)
    return struct.pack("<i", len(body)) + body


def _cigar(text: str):
    import re

    return re.findall(r"(\d+)([MIDNSHP=X])", text)


def decode_record(data: bytes, names: list[str], core: bool = False) -> dict:
    """A record's fields; core=True leaves out seq, qual and options."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, nref, npos, tlen = struct.unpack_from("<2i2B3H4i", data)
    k = 32
    name, k = data[k : k + n_name - 1].decode(), k + n_name
    ops, k = struct.unpack_from(f"<{n_ops}I", data, k), k + 4 * n_ops
    packed, k = data[k : k + (n_seq + 1) // 2], k + (n_seq + 1) // 2
    qual, k = data[k : k + n_seq], k + n_seq
    options = [] if core and not (n_ops == 2 and ops[0] & 15 == 4 and ops[1] & 15 == 3) else _options(data[k:])
    cg = next((o for o in options if o["tag"] == "CG" and o["type"] == "B"), None)
    if n_ops == 2 and ops[0] & 15 == 4 and ops[1] & 15 == 3 and cg:
        ops = [int(x) for x in cg["value"].split(",")[1:]]
        options = [o for o in options if o is not cg]
    span = sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X")
    rname = names[ref] if ref >= 0 else "*"
    return {
        "qname": name, "flag": flag, "rname": rname, "pos": pos + 1, "mapq": mapq, "cigar": "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*",
        "rnext": "*" if nref < 0 else "=" if nref == ref else names[nref], "pnext": npos + 1, "tlen": tlen,
        "seq": None if core else packed.hex().translate(_NIBBLES)[:n_seq] or "*", "qual": None if core else "*" if not n_seq or qual[0] == 255 else qual.translate(_PLUS33).decode("latin-1"),
        "options": options, "end": pos + max(span, 1),
    }


# --- records as columns

_HEAD = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("nref", "<i4"), ("npos", "<i4"), ("tlen", "<i4")])
_PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)
_NIBBLE = np.full(256, 255, np.uint8)
for _i, _c in enumerate(BASES):
    _NIBBLE[[ord(_c), ord(_c.lower())]] = _i


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of slices of bytes, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def decode_columns(data: bytes, at: list[int], names: list[str], wanted: list[str]) -> dict[str, pa.Array] | None:
    """Columns of the records at places (after their sizes); None if a record needs `decode_record`."""
    buffer, at = np.frombuffer(data, np.uint8), np.array(at, np.int64)
    h = buffer[at[:, None] + np.arange(32)].reshape(-1).view(_HEAD)
    number = lambda k: h[k].astype(np.int64)
    n_name, n_ops, n_seq, ref, nref = map(number, ("n_name", "n_ops", "n_seq", "ref", "nref"))
    cigar = at + 32 + n_name
    seq = cigar + 4 * n_ops
    qual = seq + (n_seq + 1) // 2
    size = buffer[(at - 4)[:, None] + np.arange(4)].reshape(-1).view("<i4").astype(np.int64)
    rest, end = qual + n_seq, at + size
    shapes: dict[bytes, int] = {}
    codes = [shapes.setdefault(data[a:b], len(shapes)) for a, b in zip(cigar.tolist(), seq.tolist())]
    texts, spans = [], []
    for raw in shapes:
        ops = struct.unpack(f"<{len(raw) // 4}I", raw)
        if len(ops) == 2 and ops[0] & 15 == 4 and ops[1] & 15 == 3:
            return None  # the operations may be in a tag
        texts.append("".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*")
        spans.append(max(sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X"), 1))
    codes = np.array(codes, np.int64)
    known = pa.array([*names, "*"])
    refs = known.take(pa.array(np.where(ref < 0, len(names), ref)))

    def bases():
        packed = (n_seq + 1) // 2
        pairs = _PAIRS[buffer[_places(seq, packed)]].reshape(-1)
        letters = pairs[_places(2 * (np.cumsum(packed) - packed), n_seq)]
        return pc.if_else(pa.array(n_seq == 0), "*", _strings(letters, n_seq))

    first = buffer[np.minimum(qual, len(buffer) - 1)]
    lacks = (n_seq == 0) | (first == 255)

    def qualities():
        own = np.where(lacks, 0, n_seq)
        return pc.if_else(pa.array(lacks), "*", _strings(buffer[_places(qual, own)] + 33, own))

    if "qual" in wanted:
        own = buffer[_places(qual, np.where(lacks, 0, n_seq))]
        if (own > 94).any():
            return None

    def options():
        kind = BAM_ARROW.field("options").type
        if (rest == end).all():
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1, np.int32)), pa.array([], kind.value_type)).cast(kind)
        return pa.array([_options(data[a:b]) for a, b in zip(rest.tolist(), end.tolist())], kind)

    i32 = lambda x: pa.array(x, pa.int32())
    make = {
        "qname": lambda: _strings(buffer[_places(at + 32, n_name - 1)], n_name - 1), "flag": lambda: i32(number("flag")), "rname": lambda: refs, "pos": lambda: i32(number("pos") + 1), "mapq": lambda: i32(number("mapq")),
        "cigar": lambda: pa.array(texts).take(pa.array(codes)), "rnext": lambda: pc.if_else(pa.array(nref < 0), "*", pc.if_else(pa.array(nref == ref), "=", known.take(pa.array(np.where(nref < 0, len(names), nref))))),
        "pnext": lambda: i32(number("npos") + 1), "tlen": lambda: i32(number("tlen")), "seq": bases, "qual": qualities, "options": options, "end": lambda: i32(number("pos") + np.array(spans, np.int64)[codes]),
    }
    return {n: make[n]() for n in wanted if n in make}


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a text column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], np.diff(offsets)


def encode_columns(batch: pa.RecordBatch, ids: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray] | None:
    """(records of a batch, their ends in it, how many reference bases each has); None if a record needs `encode_record`."""
    column = lambda n: batch.column(batch.schema.get_field_index(n))
    fields = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    n = batch.num_rows
    has_options = "options" in batch.schema.names and (column("options").null_count < n and (pc.max(pc.list_value_length(column("options"))).as_py() or 0) > 0)
    if not n or any(column(f).null_count for f in fields):
        return None
    number = lambda k: column(k).to_numpy(zero_copy_only=False).astype(np.int64)

    def coded(name: str, f):
        """f of each distinct text of a column, and which one a row has."""
        d = column(name).dictionary_encode()
        return [f(x) for x in d.dictionary.to_pylist()], d.indices.to_numpy().astype(np.int64)

    shapes, shape = coded("cigar", lambda x: [(int(k), o) for k, o in _cigar(x)])
    if any(len(ops) > 65535 for ops in shapes):
        return None
    raws = [np.frombuffer(struct.pack(f"<{len(ops)}I", *(k << 4 | OPS.index(o) for k, o in ops)), np.uint8) for ops in shapes]
    span = np.array([sum(k for k, o in ops if o in "MDN=X") or 1 for ops in shapes], np.int64)[shape]
    n_ops = np.array([len(ops) for ops in shapes], np.int64)[shape]
    seq, n_seq = _text_bytes(pc.if_else(pc.equal(column("seq"), "*"), "", column("seq")))
    lacks = pc.equal(column("qual"), "*").to_numpy(zero_copy_only=False)
    qual, n_qual = _text_bytes(pc.if_else(pc.equal(column("qual"), "*"), "", column("qual")))
    name, n_name = _text_bytes(column("qname"))
    if (_NIBBLE[seq] == 255).any() or (n_qual[~lacks] != n_seq[~lacks]).any() or (qual < 33).any() or (n_name > 254).any():
        return None
    tags = [_encode_options(x) for x in column("options").to_pylist()] if has_options else []
    n_tags = np.array([len(x) for x in tags], np.int64) if tags else np.zeros(n, np.int64)
    ref_of, ref_at = coded("rname", lambda x: ids.get(x, -1))
    next_of, next_at = coded("rnext", lambda x: -2 if x == "=" else ids.get(x, -1))
    ref, nref = np.array(ref_of, np.int64)[ref_at], np.array(next_of, np.int64)[next_at]
    packed, pos = (n_seq + 1) // 2, number("pos")
    beg = np.maximum(pos - 1, 0)
    last, region = beg + span - 1, np.zeros(n, np.int64)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        region = np.where(beg >> shift == last >> shift, first + (beg >> shift), region)
    size = 32 + n_name + 1 + 4 * n_ops + packed + n_seq + n_tags
    ends = np.cumsum(size + 4)
    start = ends - size
    out = np.zeros(ends[-1], np.uint8)
    h = np.zeros(n, _HEAD)
    for k, x in (("ref", ref), ("pos", pos - 1), ("n_name", n_name + 1), ("mapq", number("mapq")), ("bin", region), ("n_ops", n_ops), ("flag", number("flag")), ("n_seq", n_seq), ("nref", np.where(nref == -2, ref, nref)), ("npos", number("pnext") - 1), ("tlen", number("tlen"))):
        low, high = np.iinfo(_HEAD[k]).min, np.iinfo(_HEAD[k]).max
        if ((x < low) | (x > high)).any():
            return None
        h[k] = x
    out[(start - 4)[:, None] + np.arange(4)] = size.astype("<i4").view(np.uint8).reshape(-1, 4)
    out[start[:, None] + np.arange(32)] = h.view(np.uint8).reshape(-1, 32)
    at = start + 32
    out[_places(at, n_name)] = name
    at = at + n_name + 1
    out[_places(at, 4 * n_ops)] = np.concatenate([np.concatenate(raws)[:0], *(raws[i] for i in shape.tolist())])
    at = at + 4 * n_ops
    own = np.repeat(at, n_seq)
    k = np.arange(len(seq)) - np.repeat(np.cumsum(n_seq) - n_seq, n_seq)
    code, odd = _NIBBLE[seq], k & 1 == 1
    out[(own + k // 2)[~odd]] = code[~odd] << 4
    out[(own + k // 2)[odd]] |= code[odd]
    at = at + packed
    out[_places(at[~lacks], n_seq[~lacks])] = qual - 33
    out[_places(at[lacks], n_seq[lacks])] = 255
    if tags:
        out[_places(at + n_seq, n_tags)] = np.frombuffer(b"".join(tags), np.uint8)
    return out.tobytes(), ends, span


def read_bai(raw: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """Per reference: chunks by bin, and the linear index."""
    if raw[:4] != b"BAI\x01":
        raise ValueError("not a BAI file")
    n, k, out = struct.unpack_from("<i", raw, 4)[0], 8, []
    for _ in range(n):
        bins = {}
        m, k = struct.unpack_from("<i", raw, k)[0], k + 4
        for _ in range(m):
            number, c = struct.unpack_from("<Ii", raw, k)
            flat = struct.unpack_from(f"<{2 * c}Q", raw, k + 8)
            bins[number] = list(zip(flat[::2], flat[1::2]))
            k += 8 + 16 * c
        m, k = struct.unpack_from("<i", raw, k)[0], k + 4
        linear = list(struct.unpack_from(f"<{m}Q", raw, k))
        k += 8 * m
        out.append((bins, linear))
    return out


class BaiBuilder:
    """An index of records added in order of coordinate."""

    def __init__(self, refs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(refs)]
        self.linear: list[dict[int, int]] = [{} for _ in range(refs)]
        self.meta = [[None, 0, 0, 0] for _ in range(refs)]
        self.unplaced = 0

    def add(self, ref: int, pos: int, end: int, flag: int, beg_offset: int, end_offset: int) -> None:
        """pos and end are 1-based and closed."""
        if ref < 0 or pos < 1:
            self.unplaced += 1
            return
        chunks = self.bins[ref].setdefault(region_bin(pos - 1, end), [])
        if chunks and chunks[-1][1] >> 16 == beg_offset >> 16:
            chunks[-1][1] = end_offset
        else:
            chunks.append([beg_offset, end_offset])
        for w in range(pos - 1 >> 14, (end - 1 >> 14) + 1):
            self.linear[ref].setdefault(w, beg_offset)
        m = self.meta[ref]
        m[0] = beg_offset if m[0] is None else m[0]
        m[1] = end_offset
        m[3 if flag & 4 else 2] += 1

    def append(self, other: BaiBuilder, base: int) -> None:
        """Adds an index of later records, whose offsets count from byte `base`."""
        base <<= 16
        for k, (bins, linear, meta) in enumerate(zip(other.bins, other.linear, other.meta)):
            for number, chunks in bins.items():
                known, later = self.bins[k].setdefault(number, []), [[a + base, b + base] for a, b in chunks]
                if known and later and known[-1][1] >> 16 == later[0][0] >> 16:
                    known[-1][1] = later.pop(0)[1]
                known.extend(later)
            for w, at in linear.items():
                self.linear[k].setdefault(w, at + base)
            if meta[0] is not None:
                m = self.meta[k]
                self.meta[k] = [m[0] if m[0] is not None else meta[0] + base, meta[1] + base, m[2] + meta[2], m[3] + meta[3]]
        self.unplaced += other.unplaced

    def to_bytes(self) -> bytes:
        out = b"BAI\x01" + struct.pack("<i", len(self.bins))
        for bins, linear, meta in zip(self.bins, self.linear, self.meta):
            out += struct.pack("<i", len(bins) + (meta[0] is not None))
            for number, chunks in sorted(bins.items()):
                out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<2Q", *x) for x in chunks)
            if meta[0] is not None:
                out += struct.pack("<Ii4Q", 37450, 2, *meta)
            n, last = max(linear, default=-1) + 1, 0
            out += struct.pack("<i", n)
            for w in range(n):
                last = linear.get(w, last)
                out += struct.pack("<Q", last)
        return out + struct.pack("<Q", self.unplaced)


def spans(index, start: int, end: int) -> list[tuple[int, int]]:
    """Merged chunks of one reference that may hold reads of a region (1-based, closed)."""
    bins, linear = index
    first = linear[min((start - 1) >> 14, len(linear) - 1)] if linear else 0
    want = [0]
    for shift, base in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        want += range(base + (start - 1 >> shift), base + (end - 1 >> shift) + 1)
    out: list[list[int]] = []
    for a, b in sorted(c for w in want for c in bins.get(w, []) if c[1] > first):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def write_parts(rows: DataFrame, encode, path: str, head: bytes, tail: bytes = EOF_BLOCK, place=None) -> list[tuple[int, bytes]]:
    """Writes a file of parts: encode(batches) of a partition gives (bytes, note); parts follow one another in order of partition.

    Tasks write parts to the shared folder; the driver only copies their bytes, or what place(bytes, first byte) makes of
    them. Gives (first byte of a part, its note).
    """
    folder = Folder.new(rows.sparkSession, "parts")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        data, note = encode(batches)
        folder.write(f"{part:07d}", data)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([note], pa.binary())], names=["part", "note"])

    try:
        notes, out = sorted((r["part"], bytes(r["note"])) for r in rows.mapInArrow(run, "part int, note binary").collect()), []
        with open(path, "wb") as f:
            f.write(head)
            for part, note in notes:
                out.append((f.tell(), note))
                data = folder.read(f"{part:07d}")
                f.write(place(data, f.tell()) if place else data)
            f.write(tail)
        return out
    finally:
        folder.drop()


def bgzf(data: bytes) -> bytes:
    """Blocks of data, without the last empty one."""
    out = io.BytesIO()
    w = BgzfWriter(out)
    w.write(data)
    if w.buffer:
        w._flush(len(w.buffer))
    return out.getvalue()


def write_bam(alignments: DataFrame, path: str, header: dict, index: bool = False) -> None:
    """One BAM file from rows in their order, and its BAI. A part of a partition's size is in a task at once."""
    from .text import format_sam_header

    refs = [(s["SN"], int(s["LN"])) for s in header.get("SQ", [])]
    ids = {n: i for i, (n, _) in enumerate(refs)}
    text = ("\n".join(format_sam_header(header)) + "\n").encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in refs)

    def encode(batches):
        out = io.BytesIO()
        w, builder = BgzfWriter(out), BaiBuilder(len(refs))
        for batch in batches:
            made = None if index else encode_columns(batch, ids)
            if made is not None:
                w.write(made[0])
                continue
            for r in batch.to_pylist():
                before = w.tell()
                w.write(encode_record(r, ids))
                if index:
                    span = sum(int(n) for n, o in _cigar(r["cigar"]) if o in "MDN=X") or 1
                    builder.add(ids.get(r["rname"], -1), r["pos"], r["pos"] + span - 1, r["flag"], before, w.tell())
        if w.buffer:
            w._flush(len(w.buffer))
        return out.getvalue(), pickle.dumps(builder) if index else b""

    parts = write_parts(alignments, encode, path, bgzf(head))
    if index:
        builder = BaiBuilder(len(refs))
        for base, note in parts:
            builder.append(pickle.loads(note), base)
        with open(path + ".bai", "wb") as out:
            out.write(builder.to_bytes())


class _Range(InputPartition):
    def __init__(self, beg: int, end: int | None):
        super().__init__((beg, end))
        self.beg, self.end = beg, end


class _Bytes(_Range):
    """A range of bytes of a file without an index."""


def _plausible(data: bytes, k: int, refs: int) -> int | None:
    """Where the record at k ends, if it may be one."""
    if k + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, nref, npos, _ = struct.unpack_from("<3i2B3H4i", data, k)
    least = 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq
    if not (n_name > 1 and -1 <= ref < refs and -1 <= nref < refs and pos >= -1 and npos >= -1 and n_seq >= 0 and least <= size < 1 << 28):
        return None
    name = data[k + 36 : k + 35 + n_name]
    if data[k + 35 + n_name : k + 36 + n_name] not in (b"\0", b"") or not all(33 <= c <= 126 for c in name):
        return None
    return k + 4 + size


def _chained(data: bytes, k: int, plausible, chain: int) -> bool:
    """Do plausible records follow one another from k on, `chain` of them or to the end of the data?"""
    for n in range(chain):
        if k + 36 > len(data):
            return n > 0
        k = plausible(data, k)
        if k is None:
            return False
    return True


def first_record(raw, offset: int, size: int, refs: int, chain: int = 8, plausible=None) -> int | None:
    """Virtual offset of the first record that begins in a block at or after a byte offset; plausible(data, place) as `_plausible`."""
    from .indexed import next_block

    plausible = plausible or (lambda data, k: _plausible(data, k, refs))
    at = next_block(raw, offset, size)
    while at is not None:
        src = BgzfReader(raw, at << 16)
        if not src._block():
            return None
        own, data = len(src.data), src.data
        while len(data) < own + (1 << 17) and src._block():
            data += src.data
        for k in range(own):
            if _chained(data, k, plausible, chain):
                return at << 16 | k
        at = next_block(raw, at + 1, size)
    return None


class _BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chr = options["path"], options.get("chr")
        self.start, self.end = int(options.get("start", 1)), int(options["end"]) if "end" in options else None
        self.split, self.columns = int(options.get("split", 16 << 20)), options.get("columns")

    def partitions(self):
        with open(self.path, "rb") as raw:
            src = BgzfReader(raw)
            _, refs = read_bam_header(src)
            first = src.tell()
        bai = next((p for p in (self.path + ".bai", self.path[:-4] + ".bai") if os.path.exists(p)), None)
        if bai is None:
            size = os.path.getsize(self.path)
            return [_Bytes(a, a + self.split if a + self.split < size else None) for a in range(0, size, self.split)]
        with open(bai, "rb") as f:
            index = read_bai(f.read())
        if self.chr == "*":  # reads without a place come after all others
            return [_Range(max([first, *(b for bins, _ in index for number, chunks in bins.items() if number < 37450 for _, b in chunks)]), None)]
        if self.chr is not None:
            k = next((i for i, (n, _) in enumerate(refs) if n == self.chr), None)
            # a BAI knows 2^29 bases; what lies beyond is in none of its bins
            length = refs[k][1] if k is not None else 0
            if length > 1 << 29:
                return [_Range(first, None)]
            found = [] if k is None else spans(index[k], self.start, min(self.end or 1 << 29, 1 << 29))
            return [_Range(a, b) for a, b in found] or [_Range(first, first)]
        cuts = sorted({first, *(o for _, linear in index for o in linear[:: max(1, len(linear) // 64)] if o > first)})
        return [_Range(a, b) for a, b in zip(cuts, [*cuts[1:], None])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        names = self.columns.split(",") if self.columns else BAM_ARROW.names
        schema = pa.schema([BAM_NEXT.field(n) for n in names])
        core = not {"seq", "qual", "options"} & set(names)
        with open(self.path, "rb") as raw:
            src = BgzfReader(raw)
            _, refs = read_bam_header(src)
            beg, end, known = partition.beg, partition.end, [n for n, _ in refs]
            if isinstance(partition, _Bytes):
                size = os.path.getsize(self.path)
                beg = first_record(raw, beg, size, len(refs)) if beg else src.tell()
                end = first_record(raw, end, size, len(refs)) if end else None
                if beg is None:
                    return
            for data, at, begs, nexts in _record_runs(raw, beg, end):
                columns = decode_columns(data, at, known, [*dict.fromkeys([*names, "rname", "pos", "end"])])
                if columns is None:
                    rows = [decode_record(data[k : k + struct.unpack_from("<i", data, k - 4)[0]], known, core) for k in at]
                    columns = {n: pa.array([r[n] for r in rows], BAM_NEXT.field(n).type) for n in {*names, "rname", "pos", "end"} - {"ordinal", "next"}}
                columns |= {"ordinal": pa.array(begs, pa.int64()), "next": pa.array(nexts, pa.int64())}
                batch = pa.RecordBatch.from_arrays([columns[n] for n in names], schema=schema)
                if self.chr is not None:
                    inside = pc.equal(columns["rname"], self.chr)
                    if self.chr != "*":
                        inside = pc.and_(inside, pc.greater_equal(columns["end"], self.start))
                        inside = inside if self.end is None else pc.and_(inside, pc.less_equal(columns["pos"], self.end))
                    batch = batch.filter(inside)
                if batch.num_rows:
                    yield batch


def _record_runs(raw, beg: int, end: int | None, most: int = 5000) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """(bytes, places of records in them, their virtual offsets, those of the next ones) of the records from beg to end, in runs."""
    src = BgzfReader(raw, beg)
    data, k, blocks = src.data[src.at :], 0, [(-src.at, src.start)] if src.data else []  # (where a block's first byte lies in data, its place in the file)
    at, begs, nexts, after = [], [], [], src.next  # after: where the block after data begins

    def virtual(p: int) -> int:
        while len(blocks) > 1 and blocks[1][0] <= p:
            blocks.pop(0)
        return (blocks[0][1] << 16 | p - blocks[0][0]) if blocks and p < len(data) else after << 16

    while True:
        while len(data) - k < 4 or len(data) - k < 4 + struct.unpack_from("<i", data, k)[0]:
            if at:  # what is whole goes on before data grows
                yield data, at, begs, nexts
                at, begs, nexts = [], [], []
            data, blocks, k = data[k:], [(p - k, place) for p, place in blocks], 0
            grown, parts = len(data), [data]
            while grown < 1 << 20 and src._block():
                if src.data:
                    blocks.append((grown, src.start))
                    parts.append(src.data)
                    grown, after = grown + len(src.data), src.next
            if len(parts) == 1:  # the file's end, or a record longer than that
                while (more := src._block()) and not src.data:
                    pass
                if not more:
                    return
                blocks.append((grown, src.start))
                parts.append(src.data)
                after = src.next
            data = b"".join(parts)
        own = virtual(k)
        if end is not None and own >= end:
            break
        size = struct.unpack_from("<i", data, k)[0]
        at.append(k + 4)
        begs.append(own)
        k += 4 + size
        nexts.append(virtual(k))
        if len(at) == most:
            yield data, at, begs, nexts
            at, begs, nexts = [], [], []
    if at:
        yield data, at, begs, nexts


class BamSource(DataSource):
    """format("bam"): options chr, start, end, columns (names, by commas), split (bytes).

    `ordinal` is a record's virtual offset; `next`, if asked for among the columns, that of the one after it.
    """

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        kinds = {x.split(" ", 1)[0]: x for x in [*re.split(r", (?=\w+ )", BAM_SCHEMA), "next long"]}
        return ", ".join(kinds[n] for n in self.options["columns"].split(",")) if "columns" in self.options else BAM_SCHEMA

    def reader(self, schema):
        return _BamReader(self.options)


#: what a scan of a part of the fields is good for
MODES = {
    "region": ("rname", "pos", "end"), "coordinate": ("rname", "pos", "flag", "end"), "queryname": ("qname", "flag"), "pointer": ("rname", "pos", "end", "flag", "ordinal", "next"),
    "normal": tuple(BAM_ARROW.names),
}


def read_bam(spark: SparkSession, path: str, chr: str | None = None, start: int | None = None, end: int | None = None, columns: tuple[str, ...] | str | None = None, split: int | None = None) -> DataFrame:  # noqa: A002
    """columns: names, or one of MODES; fields that aren't asked for aren't decoded."""
    columns = ",".join(MODES.get(columns, columns)) if columns else None
    spark.dataSource.register(BamSource)
    r = spark.read.format("bam").option("path", path)
    for k, x in (("chr", chr), ("start", start), ("end", end), ("columns", columns), ("split", split)):
        if x is not None:
            r = r.option(k, str(x))
    return r.load()


def bam_header(path: str) -> dict:
    from .text import parse_sam_header

    with open(path, "rb") as raw:
        return parse_sam_header([x for x in read_bam_header(BgzfReader(raw))[0].split("\n") if x])


# --- 2bit


_CODES = np.zeros(256, np.uint8)
for _c, _v in (("T", 0), ("C", 1), ("A", 2), ("G", 3)):
    _CODES[[ord(_c), ord(_c.lower())]] = _v
#: bytes of sequences that a task holds before it passes them on
HELD = 1 << 24
_LETTERS = np.array([[ord("TCAG"[b >> s & 3]) for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)


def _runs(where: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of True."""
    turn = np.flatnonzero(np.diff(np.concatenate([[False], where, [False]]).astype(np.int8)))
    return list(zip(turn[::2].tolist(), (turn[1::2] - turn[::2]).tolist()))


def encode_sequence(seq: str) -> bytes:
    """A sequence's record: length, runs of N and of lower case, and four bases a byte."""
    x = np.frombuffer(seq.encode(), np.uint8)
    codes = np.concatenate([_CODES[x], np.zeros(-len(x) % 4, np.uint8)]).reshape(-1, 4)
    packed = (codes << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()
    block = lambda xs: struct.pack(f"<I{2 * len(xs)}I", len(xs), *[s for s, _ in xs], *[n for _, n in xs])
    return struct.pack("<I", len(seq)) + block(_runs((x == 78) | (x == 110))) + block(_runs(x > 96)) + struct.pack("<I", 0) + packed


def twobit_head(names: list[str], sizes: list[int]) -> bytes:
    head = b"\x43\x27\x41\x1a" + struct.pack("<3I", 0, len(names), 0)
    at, index = len(head) + sum(5 + len(n.encode()) for n in names), b""
    for name, size in zip(names, sizes):
        index += bytes([len(name.encode())]) + name.encode() + struct.pack("<I", at)
        at += size
    return head + index


def encode_twobit(sequences: list[tuple[str, str]]) -> bytes:
    bodies = [encode_sequence(s) for _, s in sequences]
    return twobit_head([n for n, _ in sequences], [len(b) for b in bodies]) + b"".join(bodies)


def twobit_index(raw) -> tuple[str, list[tuple[str, int]]]:
    """(byte order, (name, place) of each sequence)."""
    magic = raw.read(4)
    e = "<" if magic == b"\x43\x27\x41\x1a" else ">"
    if magic not in (b"\x43\x27\x41\x1a", b"\x1a\x41\x27\x43"):
        raise ValueError("not a 2bit file")
    _, n, _ = struct.unpack(e + "3I", raw.read(12))
    index = []
    for _ in range(n):
        own = raw.read(raw.read(1)[0]).decode()
        index.append((own, struct.unpack(e + "I", raw.read(4))[0]))
    return e, index


def decode_region(raw, e: str, at: int, start: int = 1, end: int | None = None, mask: bool = False) -> str | None:
    """Bases of a region of the sequence at a place, clamped to it; only its bytes are read."""
    raw.seek(at)
    size = struct.unpack(e + "I", raw.read(4))[0]
    lists = []
    for _ in range(2):
        m = struct.unpack(e + "I", raw.read(4))[0]
        xs = np.frombuffer(raw.read(8 * m), e + "u4").astype(np.int64)
        lists.append((xs[:m], xs[:m] + xs[m:]))
    raw.read(4)
    lo, hi = max(start, 1) - 1, size if end is None else min(end, size)
    if lo >= hi:
        return "" if size == 0 else None
    raw.seek(lo // 4, 1)
    out = _LETTERS[np.frombuffer(raw.read((hi + 3) // 4 - lo // 4), np.uint8)].reshape(-1)[lo % 4 :][: hi - lo].copy()
    for k, (a, b) in enumerate(lists[: 1 + mask]):
        for i in np.flatnonzero((a < hi) & (b > lo)):
            part = slice(max(int(a[i]) - lo, 0), int(b[i]) - lo)
            out[part] = 78 if not k else out[part] | 32
    return out.tobytes().decode()


def decode_twobit(raw, name: str | None = None, mask: bool = False) -> Iterator[tuple[str, str]]:
    """(name, sequence) of all or one sequence of a file object, in either byte order."""
    e, index = twobit_index(raw)
    for own, at in index:
        if name is None or own == name:
            yield own, decode_region(raw, e, at, mask=mask)


def read_twobit_region(path: str, chr: str, start: int = 1, end: int | None = None, mask: bool = False) -> str | None:  # noqa: A002
    """Bases of a region; null for an unknown name or nothing."""
    with open(path, "rb") as raw:
        e, index = twobit_index(raw)
        at = dict(index).get(chr)
        return None if at is None else decode_region(raw, e, at, start, end, mask)


def read_twobit(spark: SparkSession, path: str, mask: bool = False) -> DataFrame:
    """name, sequence: the driver reads the index, and gives each task names with their places, to which it seeks."""
    with open(path, "rb") as raw:
        order, index = twobit_index(raw)

    def run(batches):
        with open(path, "rb") as raw:
            for b in batches:
                names, held, size = b.column("name").to_pylist(), [], 0
                for i, at in enumerate(b.column("at").to_pylist()):
                    held.append(decode_region(raw, order, at, mask=mask))
                    size += len(held[-1])
                    if size > HELD or i + 1 == len(names):
                        yield pa.RecordBatch.from_arrays([pa.array(names[i + 1 - len(held) : i + 1], pa.string()), pa.array(held, pa.string())], names=["name", "sequence"])
                        held, size = [], 0

    return spark.createDataFrame(index, "name string, at long").repartition(max(1, min(len(index), 200))).mapInArrow(run, "name string, sequence string")


def write_twobit(sequences: DataFrame, path: str) -> None:
    """One file of sequences in their order; tasks encode and write them in files of many, the index follows from their sizes."""
    folder = Folder.new(sequences.sparkSession, "twobit")
    kinds = pa.schema([("file", pa.string()), ("k", pa.int64()), ("name", pa.string()), ("size", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []

        def put():
            nonlocal n, held
            file = f"{part:07d}-{n:09d}"
            folder.write(file, b"".join(body for _, body in held))
            out = pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array(range(len(held)), pa.int64()), pa.array([name for name, _ in held], pa.string()), pa.array([len(body) for _, body in held], pa.int64())], schema=kinds)
            n, held = n + 1, []
            return out

        size = 0
        for b in batches:
            for name, seq in zip(b.column("name").to_pylist(), b.column("sequence")):
                held.append((name, encode_sequence(seq.as_py())))
                size += len(held[-1][1])
                if size > HELD:
                    yield put()
                    size = 0
        if held:
            yield put()

    try:
        rows = sorted(sequences.select("name", "sequence").mapInArrow(run, "file string, k long, name string, size long").collect())
        with open(path, "wb") as out:
            out.write(twobit_head([r["name"] for r in rows], [r["size"] for r in rows]))
            for file in dict.fromkeys(r["file"] for r in rows):
                out.write(folder.read(file))
    finally:
        folder.drop()
