"""CRAM 3.0 as a data source, and a writer that needs no reference.

The driver reads the heads of containers (or the CRAI beside the file) and gives containers to tasks; a region reads only
those that may overlap it. Bases come from a FASTA file with its .fai, a 2bit file, or a slice's embedded reference.
The writer stores the bases themselves; its tasks write containers, whose heads are completed when the parts are put
together, as they hold running numbers of records.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import pickle
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import rans
from .binary import BAM_ARROW, BAM_SCHEMA, _cigar, _encode_options, _options, read_twobit_region, write_parts
from .indexed import read_crai, read_fasta_region
from .text import format_sam_header, parse_sam_header

RAW, GZIP, BZIP2, LZMA, RANS = range(5)
END = bytes.fromhex("0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b")
BASES = "ACGTN"


# --- numbers


def itf8(data: bytes, k: int) -> tuple[int, int]:
    b = data[k]
    if b < 0x80:
        return b, k + 1
    if b < 0xC0:
        return (b & 0x3F) << 8 | data[k + 1], k + 2
    if b < 0xE0:
        return (b & 0x1F) << 16 | data[k + 1] << 8 | data[k + 2], k + 3
    if b < 0xF0:
        return (b & 0x0F) << 24 | data[k + 1] << 16 | data[k + 2] << 8 | data[k + 3], k + 4
    x = (b & 0x0F) << 28 | data[k + 1] << 20 | data[k + 2] << 12 | data[k + 3] << 4 | data[k + 4] & 0x0F
    return x - (1 << 32) if x >> 31 else x, k + 5


def put_itf8(x: int) -> bytes:
    x &= 0xFFFFFFFF
    if x < 1 << 7:
        return bytes([x])
    if x < 1 << 14:
        return struct.pack(">H", x | 0x8000)
    if x < 1 << 21:
        return struct.pack(">I", x | 0xC00000)[1:]
    if x < 1 << 28:
        return struct.pack(">I", x | 0xE0000000)
    return bytes([0xF0 | x >> 28, x >> 20 & 255, x >> 12 & 255, x >> 4 & 255, x & 15])


def ltf8(data: bytes, k: int) -> tuple[int, int]:
    b, n = data[k], 0
    while n < 8 and b & 0x80 >> n:
        n += 1
    x = b & (0x7F >> n) if n < 8 else 0
    for c in data[k + 1 : k + 1 + n]:
        x = x << 8 | c
    return x - (1 << 64) if x >> 63 else x, k + 1 + n


def put_ltf8(x: int) -> bytes:
    x &= (1 << 64) - 1
    n = next((n for n in range(8) if x < 1 << 7 * (n + 1)), 8)
    raw = x.to_bytes(n + 1, "big") if n < 8 else b"\xff" + x.to_bytes(8, "big")
    return raw if n == 8 else bytes([raw[0] | (0xFF << 8 - n & 0xFF)]) + raw[1:]


def _array(data: bytes, k: int) -> tuple[list[int], int]:
    n, k = itf8(data, k)
    out = []
    for _ in range(n):
        x, k = itf8(data, k)
        out.append(x)
    return out, k


def _put_array(xs) -> bytes:
    return put_itf8(len(xs)) + b"".join(map(put_itf8, xs))


# --- blocks and containers


def unpack_block(method: int, data: bytes, size: int) -> bytes:
    if method == RAW:
        return data
    if method == GZIP:
        return gzip.decompress(data)
    if method == BZIP2:
        return bz2.decompress(data)
    if method == LZMA:
        return lzma.decompress(data)
    if method == RANS:
        return rans.decode(data)
    raise ValueError(f"unknown compression {method} of a CRAM block")


def pack_block(kind: int, number: int, data: bytes, methods=(RAW, GZIP)) -> bytes:
    """A block by the method that takes least."""
    makers = {RAW: lambda: data, GZIP: lambda: gzip.compress(data, 6, mtime=0), BZIP2: lambda: bz2.compress(data), LZMA: lambda: lzma.compress(data), RANS: lambda: rans.encode(data, 0)}
    method, body = min(((m, makers[m]()) for m in (methods if len(data) > 16 else (RAW,))), key=lambda x: len(x[1]))
    out = bytes([method, kind]) + put_itf8(number) + put_itf8(len(body)) + put_itf8(len(data)) + body
    return out + struct.pack("<I", zlib.crc32(out))


def read_block(data: bytes, k: int) -> tuple[int, int, bytes, int]:
    """(kind, number, content, next place) of a block."""
    start, method, kind = k, data[k], data[k + 1]
    number, k = itf8(data, k + 2)
    packed, k = itf8(data, k)
    size, k = itf8(data, k)
    if struct.unpack_from("<I", data, k + packed)[0] != zlib.crc32(data[start : k + packed]):
        raise ValueError("a CRAM block is damaged")
    return kind, number, unpack_block(method, data[k : k + packed], size), k + packed + 4


def read_container(raw) -> dict | None:
    """The head of the container at the file's place; its blocks follow."""
    at = raw.tell()
    head = raw.read(128)
    if len(head) < 20:
        return None
    length, k = struct.unpack_from("<i", head)[0], 4
    out = {"at": at, "length": length}
    for name in ("ref", "start", "span", "records"):
        out[name], k = itf8(head, k)
    for name in ("counter", "bases"):
        out[name], k = ltf8(head, k)
    out["blocks"], k = itf8(head, k)
    n, _ = itf8(head, k)
    if len(head) < k + 5 * (n + 1) + 4:
        head += raw.read(5 * (n + 1) + 4)
    out["landmarks"], k = _array(head, k)
    if struct.unpack_from("<I", head, k)[0] != zlib.crc32(head[:k]):
        raise ValueError("the head of a CRAM container is damaged")
    out["body"] = at + k + 4
    raw.seek(out["body"])
    return out


def container_head(length: int, ref: int, start: int, span: int, records: int, counter: int, bases: int, blocks: int, landmarks) -> bytes:
    out = struct.pack("<i", length) + b"".join(map(put_itf8, (ref, start, span, records))) + put_ltf8(counter) + put_ltf8(bases) + put_itf8(blocks) + _put_array(landmarks)
    return out + struct.pack("<I", zlib.crc32(out))


def read_header(raw) -> str:
    """The SAM header's text; the file's place is then at the first container of records."""
    if raw.read(4) != b"CRAM":
        raise ValueError("not a CRAM file")
    if raw.read(2)[0] != 3:
        raise ValueError("only CRAM 3 is read")
    raw.read(20)
    c = read_container(raw)
    body = raw.read(c["length"])
    _, _, text, _ = read_block(body, 0)
    return text[4 : 4 + struct.unpack_from("<i", text)[0]].rstrip(b"\0").decode()


# --- encodings


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return x


class _Slice:
    """The streams of a slice: bits of the core block, and a place in each external block."""

    def __init__(self, core: bytes, external: dict[int, bytes]):
        self.bits, self.external, self.at = _Bits(core), external, dict.fromkeys(external, 0)

    def integer(self, number: int) -> int:
        x, self.at[number] = itf8(self.external[number], self.at[number])
        return x

    def byte(self, number: int) -> int:
        self.at[number] += 1
        return self.external[number][self.at[number] - 1]

    def take(self, number: int, n: int) -> bytes:
        self.at[number] += n
        return self.external[number][self.at[number] - n : self.at[number]]

    def until(self, number: int, stop: int) -> bytes:
        data, at = self.external[number], self.at[number]
        end = data.index(stop, at)
        self.at[number] = end + 1
        return data[at:end]


def decoder(data: bytes, k: int, kind: str):
    """(function of a slice that gives a value, next place) of an encoding; kind: int, byte or bytes."""
    codec, k = itf8(data, k)
    size, k = itf8(data, k)
    p, end = k, k + size
    if codec == 0:
        return (lambda s: 0), end
    if codec == 1:
        number, _ = itf8(data, p)
        return ((lambda s: s.byte(number)) if kind == "byte" else (lambda s: s.integer(number))), end
    if codec == 3:
        symbols, p = _array(data, p)
        lengths, p = _array(data, p)
        if len(symbols) == 1 and not lengths[0]:
            return (lambda s, x=symbols[0]: x), end
        table, code, last = {}, 0, 0
        for n, x in sorted(zip(lengths, symbols)):
            code <<= n - last
            table[n, code] = x
            code, last = code + 1, n

        def huffman(s):
            x = n = 0
            while True:
                x, n = x << 1 | s.bits.read(1), n + 1
                if (n, x) in table:
                    return table[n, x]

        return huffman, end
    if codec == 4:
        length, p = decoder(data, p, "int")
        inner, at = itf8(data, p)
        if inner == 1:
            number, _ = itf8(data, itf8(data, at)[1])
            return (lambda s: s.take(number, length(s))), end
        value, p = decoder(data, p, "byte")
        return (lambda s: bytes(value(s) for _ in range(length(s)))), end
    if codec == 5:
        stop, (number, _) = data[p], itf8(data, p + 1)
        return (lambda s: s.until(number, stop)), end
    a, p = itf8(data, p)
    if codec == 9:

        def gamma(s):
            n = 0
            while not s.bits.read(1):
                n += 1
            return (1 << n | s.bits.read(n)) - a

        return gamma, end
    b, p = itf8(data, p)
    if codec == 6:
        return (lambda s: s.bits.read(b) - a), end

    def ones(s) -> int:
        n = 0
        while s.bits.read(1):
            n += 1
        return n

    if codec == 7:

        def subexponential(s):
            n = ones(s)
            return (s.bits.read(b) if not n else 1 << b + n - 1 | s.bits.read(b + n - 1)) - a

        return subexponential, end
    if codec == 8:
        return (lambda s: (ones(s) << b | s.bits.read(b)) - a), end
    if codec == 2:

        def golomb(s):
            q, n = ones(s), (b - 1).bit_length()
            short = (1 << n) - b
            r = s.bits.read(n - 1) if n else 0
            if n and r >= short:
                r = (r << 1 | s.bits.read(1)) - short
            return q * b + r - a

        return golomb, end
    raise ValueError(f"unknown encoding {codec}")


_KINDS = dict.fromkeys("FC BS BA QS".split(), "byte") | dict.fromkeys("RN IN SC BB QQ".split(), "bytes")


class Compression:
    """A container's compression header."""

    def __init__(self, data: bytes):
        _, k = itf8(data, 0)
        n, k = itf8(data, k)
        self.names, self.delta, self.needs_reference, self.matrix, self.tags = True, True, True, b"\x1b" * 5, [[]]
        for _ in range(n):
            key, k = data[k : k + 2], k + 2
            if key == b"SM":
                self.matrix, k = data[k : k + 5], k + 5
            elif key == b"TD":
                size, k = itf8(data, k)
                self.tags, k = [[line[i : i + 3] for i in range(0, len(line), 3)] for line in data[k : k + size].split(b"\0")[:-1]], k + size
            else:
                value, k = bool(data[k]), k + 1
                if key == b"RN":
                    self.names = value
                elif key == b"AP":
                    self.delta = value
                elif key == b"RR":
                    self.needs_reference = value
        # the base of each code, by the reference's base
        self.base = {r: {byte >> s & 3: b for s, b in zip((6, 4, 2, 0), BASES.replace(r, ""))} for r, byte in zip(BASES, self.matrix)}
        _, k = itf8(data, k)
        n, k = itf8(data, k)
        self.series = {}
        for _ in range(n):
            key = data[k : k + 2].decode()
            self.series[key], k = decoder(data, k + 2, _KINDS.get(key, "int"))
        _, k = itf8(data, k)
        n, k = itf8(data, k)
        self.values = {}
        for _ in range(n):
            key, k = itf8(data, k)
            self.values[bytes([key >> 16, key >> 8 & 255, key & 255])], k = decoder(data, k, "bytes")


def slice_header(data: bytes) -> dict:
    out, k = {}, 0
    for name in ("ref", "start", "span", "records"):
        out[name], k = itf8(data, k)
    out["counter"], k = ltf8(data, k)
    out["blocks"], k = itf8(data, k)
    out["ids"], k = _array(data, k)
    out["embedded"], k = itf8(data, k)
    out["md5"] = data[k : k + 16]
    return out


def _sequence(features, length: int, pos: int, bases_of, compression: Compression):
    """(bases, CIGAR operations, qualities by place) of a mapped read from its features."""
    out, ops, quals = bytearray(b"N" * length), [], {}
    at, ref = 0, pos

    def op(n: int, kind: str) -> None:
        if n:
            if ops and ops[-1][1] == kind:
                ops[-1][0] += n
            else:
                ops.append([n, kind])

    def match(n: int) -> None:
        nonlocal at, ref
        if n > 0:
            out[at : at + n] = bases_of(ref, n).ljust(n, b"N")
            op(n, "M")
            at, ref = at + n, ref + n

    for place, code, value in features:
        match(place - 1 - at)
        if code in "XBb":
            if code == "X":
                own = bases_of(ref, 1).decode().upper() or "N"
                value = compression.base.get(own, compression.base["N"])[value].encode()
            elif code == "B":
                quals[at] = value[1]
                value = bytes([value[0]])
            out[at : at + len(value)] = value
            op(len(value), "M")
            at, ref = at + len(value), ref + len(value)
        elif code in "ISi":
            out[at : at + len(value)] = value
            op(len(value), "S" if code == "S" else "I")
            at += len(value)
        elif code in "DN":
            op(value, code)
            ref += value
        elif code in "PH":
            op(value, code)
        elif code == "Q":
            quals[place - 1] = value
        elif code == "q":
            quals |= {place - 1 + i: q for i, q in enumerate(value)}
    match(length - at)
    return bytes(out), ops, quals, ref - 1


def read_slice(data: bytes, k: int, compression: Compression, refs: list[str], groups: list[str], reference) -> list[dict]:
    """The records of the slice whose head is at k; reference(name, start, end) gives bases."""
    _, _, raw, k = read_block(data, k)
    head, core, external = slice_header(raw), b"", {}
    for _ in range(head["blocks"]):
        kind, number, content, k = read_block(data, k)
        if kind == 5:
            core = content
        else:
            external[number] = content
    s, series, rows, last = _Slice(core, external), compression.series, [], head["start"]
    read = lambda key: series[key](s)
    whole = {}
    if head["embedded"] >= 0:
        whole[head["ref"]] = (head["start"], external[head["embedded"]])
    elif head["ref"] >= 0 and reference is not None and compression.needs_reference:
        whole[head["ref"]] = (head["start"], (reference(refs[head["ref"]], head["start"], head["start"] + head["span"] - 1) or "").encode())

    def bases_of(ref: int):
        def take(start: int, n: int) -> bytes:
            first, known = whole.get(ref, (0, b""))
            if first <= start and start + n <= first + len(known):
                return known[start - first : start - first + n].upper()
            if reference is None or ref < 0:
                if compression.needs_reference:
                    raise ValueError("the bases of this CRAM file need its reference")
                return b""
            return (reference(refs[ref], start, start + n - 1) or "").encode().upper()

        return take

    for number in range(head["records"]):
        flag, own = read("BF"), read("CF")
        ref = read("RI") if head["ref"] == -2 else head["ref"]
        length, ap = read("RL"), read("AP")
        pos = last = last + ap if compression.delta else ap
        group = read("RG")
        name = read("RN").decode() if compression.names else None
        r = {"mate": None, "nref": -1, "npos": 0, "tlen": 0}
        if own & 2:
            mf = read("MF")
            flag |= (0x20 if mf & 1 else 0) | (0x8 if mf & 2 else 0)
            if not compression.names:
                name = read("RN").decode()
            r |= {"nref": read("NS"), "npos": read("NP"), "tlen": read("TS")}
        elif own & 4:
            r["mate"] = number + read("NF") + 1
        options = []
        for tag in compression.tags[read("TL")]:
            options += _options(tag + compression.values[tag](s))
        quals, ops, end = {}, [], pos
        if not flag & 4:
            features, at = [], 0
            for _ in range(read("FN")):
                code = chr(read("FC"))
                at += read("FP")
                if code == "B":
                    value = (read("BA"), read("QS"))
                elif code == "i":
                    value = bytes([read("BA")])
                else:
                    value = read({"X": "BS", "I": "IN", "S": "SC", "D": "DL", "N": "RS", "P": "PD", "H": "HC", "b": "BB", "q": "QQ", "Q": "QS"}[code])
                features.append((at, code, value))
            mapq = read("MQ")
            take = (lambda start, n: b"") if own & 8 else bases_of(ref)
            seq, ops, quals, end = _sequence(features, length, pos, take, compression)
        else:
            mapq = 0
            seq = b"" if own & 8 else bytes(read("BA") for _ in range(length))
        if own & 1:
            qual = bytes(read("QS") for _ in range(length))
        else:
            qual = bytes(quals.get(i, 255) for i in range(length)) if quals else b""
        if 0 <= group < len(groups):
            options.append({"tag": "RG", "type": "Z", "value": groups[group]})
        rows.append(r | {"name": name, "flag": flag, "ref": ref, "pos": pos, "end": max(end, pos), "mapq": mapq, "cigar": "".join(f"{n}{o}" for n, o in ops) or "*", "seq": "*" if own & 8 or not length else seq.decode(), "qual": qual, "options": options})
    _resolve_mates(rows, head["counter"])
    shown = lambda k: refs[k] if k >= 0 else "*"
    return [
        {
            "qname": r["name"], "flag": r["flag"], "rname": shown(r["ref"]), "pos": r["pos"], "mapq": r["mapq"], "cigar": r["cigar"],
            "rnext": "*" if r["nref"] < 0 else "=" if r["nref"] == r["ref"] else shown(r["nref"]), "pnext": r["npos"], "tlen": r["tlen"], "seq": r["seq"],
            "qual": "*" if not r["qual"] or r["qual"][0] == 255 else "".join(chr(min(q, 93) + 33) for q in r["qual"]), "options": r["options"], "end": r["end"],
        }
        for r in rows
    ]


def _resolve_mates(rows: list[dict], counter: int) -> None:
    """Mates within a slice: each names the next one of its template; the last one's mate is the first."""
    seen: set[int] = set()
    for i, r in enumerate(rows):
        if r["mate"] is None or i in seen:
            if r["name"] is None and i not in seen:
                r["name"] = str(counter + i)
            continue
        chain, k = [i], r["mate"]
        while k is not None:
            chain.append(k)
            k = rows[k]["mate"]
        seen |= set(chain)
        name = r["name"] if r["name"] is not None else str(counter + i)
        left, right = min(rows[k]["pos"] for k in chain), max(rows[k]["end"] for k in chain)
        one = len({rows[k]["ref"] for k in chain}) == 1 and r["ref"] >= 0 and not any(rows[k]["flag"] & 4 for k in chain)
        first = min(chain, key=lambda k: (rows[k]["pos"], k))
        for k, nxt in zip(chain, [*chain[1:], chain[0]]):
            a, b = rows[k], rows[nxt]
            a["name"] = name if a["name"] is None else a["name"]
            a["nref"], a["npos"] = b["ref"], b["pos"]
            a["flag"] |= (0x20 if b["flag"] & 16 else 0) | (0x8 if b["flag"] & 4 else 0)
            a["tlen"] = (right - left + 1) * (1 if k == first else -1) if one else 0


def resolver(path: str | None):
    """reference(name, start, end) over an indexed FASTA or a 2bit file."""
    if path is None:
        return None
    if path.endswith(".2bit"):
        return lambda name, start, end: read_twobit_region(path, name, start, end)
    return lambda name, start, end: read_fasta_region(path, name, start, end)


# --- source


class _Containers(InputPartition):
    def __init__(self, found):
        super().__init__(found)
        self.found = found


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.reference, self.chr = options["path"], options.get("reference"), options.get("chr")
        self.start, self.end = int(options.get("start", 1)), int(options["end"]) if "end" in options else None

    def partitions(self):
        with open(self.path, "rb") as raw:
            names = [x["SN"] for x in parse_sam_header(read_header(raw).splitlines()).get("SQ", [])]
            want = None if self.chr is None else -1 if self.chr == "*" else names.index(self.chr) if self.chr in names else -9
            crai = self.path + ".crai"
            if want is not None and os.path.exists(crai):
                found = sorted({(e[3], e[4]) for e in read_crai(crai) if e[0] == want and (want < 0 or (e[1] <= (self.end or e[1]) and e[1] + e[2] - 1 >= self.start))})
                slices: dict[int, list] = {}
                for at, landmark in found:
                    slices.setdefault(at, []).append(landmark)
                chosen = list(slices.items())
            else:
                chosen = []
                while (c := read_container(raw)) is not None:
                    near = want is None or c["ref"] == -2 or (c["ref"] == want and (want < 0 or (c["start"] <= (self.end or c["start"]) and c["start"] + c["span"] - 1 >= self.start)))
                    if c["records"] and near:
                        chosen.append((c["at"], None))
                    raw.seek(c["body"] + c["length"])
        per = max(1, -(-len(chosen) // 1000))
        return [_Containers(chosen[a : a + per]) for a in range(0, len(chosen), per)] or [_Containers([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        reference = resolver(self.reference)
        with open(self.path, "rb") as raw:
            header = parse_sam_header(read_header(raw).splitlines())
            names, groups = [x["SN"] for x in header.get("SQ", [])], [x["ID"] for x in header.get("RG", [])]
            for at, landmarks in partition.found:
                raw.seek(at)
                c = read_container(raw)
                body = raw.read(c["length"])
                compression = Compression(read_block(body, 0)[2])
                for landmark in landmarks or c["landmarks"]:
                    rows, kept = read_slice(body, landmark, compression, names, groups, reference), []
                    for i, r in enumerate(rows):
                        if self.chr is None or (r["rname"] == self.chr and (self.chr == "*" or (r["end"] >= self.start and (self.end is None or r["pos"] <= self.end)))):
                            # containers are far more bytes apart than they hold records
                            kept.append(r | {"ordinal": (at + landmark << 20) + i})
                    if kept:
                        yield pa.RecordBatch.from_pylist(kept, schema=BAM_ARROW)


class CramSource(DataSource):
    """format("cram"): options path, reference, chr, start, end; `ordinal` grows with the place in the file."""

    @classmethod
    def name(cls):
        return "cram"

    def schema(self):
        return BAM_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_cram(spark: SparkSession, path: str, reference: str | None = None, chr: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:  # noqa: A002
    spark.dataSource.register(CramSource)
    r = spark.read.format("cram").option("path", path)
    for k, x in (("reference", reference), ("chr", chr), ("start", start), ("end", end)):
        r = r.option(k, str(x)) if x is not None else r
    return r.load()


def cram_header(path: str) -> dict:
    with open(path, "rb") as raw:
        return parse_sam_header(read_header(raw).splitlines())


# --- writer

_SERIES = "BF CF RI RL AP RG RN MF NS NP TS TL FN FC FP DL BB IN SC RS PD HC MQ BA QS".split()
_NUMBER = {k: i + 1 for i, k in enumerate(_SERIES)}


def _external(number: int) -> bytes:
    body = put_itf8(number)
    return put_itf8(1) + put_itf8(len(body)) + body


def _by_length(number: int) -> bytes:
    """Lengths and bytes in two external blocks."""
    body = _external(number + 1000) + _external(number)
    return put_itf8(4) + put_itf8(len(body)) + body


def _map(entries: list[bytes]) -> bytes:
    body = put_itf8(len(entries)) + b"".join(entries)
    return put_itf8(len(body)) + body


def encode_container(rows: list[dict], ids: dict[str, int], groups: dict[str, int], methods: dict[str, tuple]) -> tuple[bytes, dict]:
    """(body of a container of one slice, what its head needs)."""
    streams: dict[int, bytearray] = {}
    stream = lambda number: streams.setdefault(number, bytearray())
    put = lambda key, x: stream(_NUMBER[key]).extend(put_itf8(x))
    byte = lambda key, x: stream(_NUMBER[key]).append(x)

    def array(number: int, x: bytes) -> None:
        stream(number + 1000).extend(put_itf8(len(x)))
        stream(number).extend(x)

    refs = {ids.get(r["rname"], -1) for r in rows}
    ref = refs.pop() if len(refs) == 1 else -2
    ordered = ref >= 0 and all(a["pos"] <= b["pos"] for a, b in zip(rows, rows[1:]))
    lines: dict[tuple, int] = {}
    tag_numbers: dict[bytes, int] = {}
    last, spans, bases = rows[0]["pos"] if ordered else 0, {}, 0
    start = min(r["pos"] for r in rows) if ref >= 0 else 0
    if ordered:
        last = start
    for r in rows:
        own_ref, pos = ids.get(r["rname"], -1), r["pos"]
        cigar = [(int(n), o) for n, o in _cigar(r["cigar"])]
        query = sum(n for n, o in cigar if o in "MIS=X")
        seq = "" if r["seq"] == "*" else r["seq"]
        length = len(seq) or query
        unknown, quals = not seq, r["qual"] != "*"
        put("BF", r["flag"])
        put("CF", 2 | (1 if quals else 0) | (8 if unknown else 0))
        if ref == -2:
            put("RI", own_ref)
        put("RL", length)
        put("AP", pos - last if ordered else pos)
        last = pos
        options = [dict(o) for o in r.get("options") or []]
        group = next((groups[o["value"]] for o in options if o["tag"] == "RG" and o["value"] in groups), -1)
        options = [o for o in options if group < 0 or o["tag"] != "RG"]
        put("RG", group)
        stream(_NUMBER["RN"]).extend(r["qname"].encode() + b"\0")
        put("MF", (1 if r["flag"] & 0x20 else 0) | (2 if r["flag"] & 8 else 0))
        put("NS", own_ref if r["rnext"] == "=" else ids.get(r["rnext"], -1))
        put("NP", r["pnext"])
        put("TS", r["tlen"])
        raws = [_encode_options([o]) for o in options]
        put("TL", lines.setdefault(tuple(x[:3] for x in raws), len(lines)))
        for x in raws:
            array(tag_numbers.setdefault(x[:3], 2000 + 2 * len(tag_numbers) + (len(tag_numbers) // 500) * 1000), x[3:])
        span = sum(n for n, o in cigar if o in "MDN=X")
        if not r["flag"] & 4:
            features, at = [], 1
            for n, o in cigar:
                if o in "MIS=X":
                    if not unknown:
                        features.append((at, {"I": "I", "S": "S"}.get(o, "b"), seq[at - 1 : at - 1 + n].encode()))
                    elif o in "IS":
                        features.append((at, o, b"N" * n))
                    at += n
                else:
                    features.append((at, o, n))
            put("FN", len(features))
            before = 0
            for at, code, value in features:
                byte("FC", ord(code))
                put("FP", at - before)
                before = at
                if isinstance(value, bytes):
                    array(_NUMBER[{"b": "BB", "I": "IN", "S": "SC"}[code]], value)
                else:
                    put({"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[code], value)
            put("MQ", r["mapq"])
        elif not unknown:
            stream(_NUMBER["BA"]).extend(seq.encode())
        if quals:
            stream(_NUMBER["QS"]).extend(bytes(ord(q) - 33 for q in r["qual"]))
        a, b = spans.get(own_ref, (pos, pos))
        spans[own_ref] = min(a, pos), max(b, pos + max(span, 1) - 1)
        bases += length
    tags = b"".join(b"".join(line) + b"\0" for line in lines)
    preservation = _map([b"RN\x01", b"AP" + bytes([ordered]), b"RR\x00", b"SM" + b"\x1b" * 5, b"TD" + put_itf8(len(tags)) + tags])
    encodings = []
    for k in _SERIES:
        e = _by_length(_NUMBER[k]) if k in ("BB", "IN", "SC") else (lambda body: put_itf8(5) + put_itf8(len(body)) + body)(b"\0" + put_itf8(_NUMBER[k])) if k == "RN" else _external(_NUMBER[k])
        encodings.append(k.encode() + e)
    values = [put_itf8(t[0] << 16 | t[1] << 8 | t[2]) + _by_length(n) for t, n in tag_numbers.items()]
    head = pack_block(1, 0, preservation + _map(encodings) + _map(values))
    names = {v: k for k, v in _NUMBER.items()}
    blocks = [pack_block(5, 0, b"")] + [pack_block(4, n, bytes(x), methods.get(names.get(n, ""), methods["*"])) for n, x in sorted(streams.items())]
    span = spans[ref][1] - spans[ref][0] + 1 if ref >= 0 else 0
    sliced = b"".join(map(put_itf8, (ref, start, span, len(rows))))
    return head, {"slice": sliced, "blocks": blocks, "ids": sorted(streams), "ref": ref, "start": start, "span": span, "records": len(rows), "bases": bases, "spans": spans}


def finish_container(head: bytes, c: dict, counter: int) -> tuple[bytes, int, int]:
    """(a container with its running number, place of its slice in the body, size of the slice)."""
    top = c["slice"] + put_ltf8(counter) + put_itf8(len(c["blocks"])) + _put_array(c["ids"]) + put_itf8(-1) + bytes(16)
    sliced = pack_block(2, 0, top, (RAW,)) + b"".join(c["blocks"])
    body = head + sliced
    return container_head(len(body), c["ref"], c["start"], c["span"], c["records"], counter, c["bases"], 2 + len(c["blocks"]), [len(head)]) + body, len(head), len(sliced)


def write_cram(alignments: DataFrame, path: str, header: dict, index: bool = False, records: int = 10_000, methods: dict[str, tuple] | None = None) -> None:
    """One CRAM file from rows in their order, and its CRAI.

    A container has up to `records` records, of one reference where rows come by it. methods: the compressions to choose
    from by data series ("*" for all others), the one that takes least being used; = and X become M.
    """
    ids = {s["SN"]: i for i, s in enumerate(header.get("SQ", []))}
    groups = {g["ID"]: i for i, g in enumerate(header.get("RG", []))}
    ways = {"*": (RAW, GZIP), "QS": (RAW, GZIP, RANS)} | (methods or {})
    ordered = header.get("HD", {}).get("SO") == "coordinate"

    def run(batches):
        held, out = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == records or (ordered and r["rname"] != held[-1]["rname"])):
                    out.append(encode_container(held, ids, groups, ways))
                    held = []
                held.append(r)
        if held:
            out.append(encode_container(held, ids, groups, ways))
        return pickle.dumps(out), b""

    text = ("\n".join(format_sam_header(header)) + "\n").encode()
    block = pack_block(0, 0, struct.pack("<i", len(text)) + text, (RAW,))
    top = b"CRAM\x03\x00" + os.path.basename(path).encode()[:20].ljust(20, b"\0") + container_head(len(block), 0, 0, 0, 0, 0, 0, 1, [0]) + block
    entries, counter = [], 0

    def place(data: bytes, at: int) -> bytes:
        nonlocal counter
        out = io.BytesIO()
        for head, c in pickle.loads(data):
            done, landmark, size = finish_container(head, c, counter)
            for ref, (a, b) in sorted(c["spans"].items()):
                entries.append((ref, a if ref >= 0 else 0, b - a + 1 if ref >= 0 else 0, at + out.tell(), landmark, size))
            out.write(done)
            counter += c["records"]
        return out.getvalue()

    write_parts(alignments, run, path, top, END, place)
    if index:
        write_crai(entries, path + ".crai")


def write_crai(entries, path: str) -> None:
    with gzip.open(path, "wt") as f:
        f.writelines("\t".join(map(str, e)) + "\n" for e in entries)


def build_crai(path: str) -> str:
    """Builds the CRAI of a CRAM file from the heads of its slices; slices of many references are read for their spans."""
    entries = []
    with open(path, "rb") as raw:
        names = [x["SN"] for x in parse_sam_header(read_header(raw).splitlines()).get("SQ", [])]
        while (c := read_container(raw)) is not None:
            body = raw.read(c["length"])
            for landmark, end in zip(c["landmarks"], [*c["landmarks"][1:], c["length"]]) if c["records"] else ():
                head = slice_header(read_block(body, landmark)[2])
                spans = {head["ref"]: (head["start"], head["start"] + head["span"] - 1)}
                if head["ref"] == -2:
                    spans = {}
                    for r in read_slice(body, landmark, Compression(read_block(body, 0)[2]), names, [], lambda *_: ""):
                        k = names.index(r["rname"]) if r["rname"] != "*" else -1
                        a, b = spans.get(k, (r["pos"], r["end"]))
                        spans[k] = min(a, r["pos"]), max(b, r["end"])
                entries += [(k, a if k >= 0 else 0, b - a + 1 if k >= 0 else 0, c["at"], landmark, end - landmark) for k, (a, b) in sorted(spans.items())]
    write_crai(entries, path + ".crai")
    return path + ".crai"
