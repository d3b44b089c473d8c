"""bigWig as a data source: the driver reads the index of blocks, tasks read and inflate the blocks themselves."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
KINDS = {1: "bedGraph", 2: "variableStep", 3: "fixedStep"}
_ROWS = pa.schema([("chr", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float32()), ("format", pa.string()), ("span", pa.int32())])


class BigWig:
    """Heads, names and blocks of a file, in either byte order."""

    def __init__(self, raw):
        self.raw = raw
        magic = raw.read(4)
        self.e = "<" if magic == struct.pack("<I", MAGIC) else ">"
        if magic not in (struct.pack("<I", MAGIC), struct.pack(">I", MAGIC)):
            raise ValueError("not a bigWig file")
        head = struct.unpack(self.e + "2H3Q2H2QIQ", raw.read(60))
        self.version, self.zooms, self.tree, self.data, self.index, self.fields, self.defined, self.sql, self.total, self.packed, self.extension = head
        self.zoom_heads = [struct.unpack(self.e + "2I2Q", raw.read(24)) for _ in range(self.zooms)]

    def at(self, fmt: str, offset: int) -> tuple:
        self.raw.seek(offset)
        return struct.unpack(self.e + fmt, self.raw.read(struct.calcsize(self.e + fmt)))

    def summary(self) -> dict | None:
        """Bases covered, least and largest value, sum and sum of squares."""
        return dict(zip(("bases", "min", "max", "sum", "squares"), self.at("Q4d", self.total))) if self.total else None

    def names(self) -> dict[int, tuple[str, int]]:
        """(name, length) by number, from the tree of names."""
        magic, _, size, _, _, _ = self.at("4I2Q", self.tree)
        if magic != TREE:
            raise ValueError("not a tree of names")
        out, todo = {}, [self.tree + 32]
        while todo:
            at = todo.pop()
            leaf, _, n = self.at("2BH", at)
            for k in range(n):
                if leaf:
                    key, number, length = self.at(f"{size}s2I", at + 4 + k * (size + 8))
                    out[number] = (key.rstrip(b"\0").decode(), length)
                else:
                    todo.append(self.at(f"{size}sQ", at + 4 + k * (size + 8))[1])
        return out

    def blocks(self, number: int | None = None, start: int = 1, end: int | None = None) -> list[tuple[int, int]]:
        """(offset, size) of the blocks that may hold values of a region (1-based, closed), or of all."""
        if self.at("I", self.index)[0] != INDEX:
            raise ValueError("not an index of blocks")
        lo, hi = (number, start - 1), (number, (1 << 32) if end is None else end)
        out, todo = [], [self.index + 48]
        while todo:
            at = todo.pop()
            leaf, _, n = self.at("2BH", at)
            for k in range(n):
                c1, s, c2, e, offset, *size = self.at("4I2Q" if leaf else "4IQ", at + 4 + k * (32 if leaf else 24))
                if number is None or ((c1, s) < hi and (c2, e) > lo):
                    out.append((offset, size[0])) if leaf else todo.append(offset)
        return sorted(out)

    def rows(self, offset: int, size: int):
        """(number, start, end, value, format, span) of a block, 1-based and closed."""
        self.raw.seek(offset)
        data = self.raw.read(size)
        data = zlib.decompress(data) if self.packed else data
        number, start, _, step, span, kind, _, n = struct.unpack_from(self.e + "5I2BH", data)
        for k in range(n):
            if kind == 1:
                a, b, v = struct.unpack_from(self.e + "2If", data, 24 + 12 * k)
                yield number, a + 1, b, v, KINDS[1], b - a
            elif kind == 2:
                a, v = struct.unpack_from(self.e + "If", data, 24 + 8 * k)
                yield number, a + 1, a + span, v, KINDS[2], span
            else:
                (v,) = struct.unpack_from(self.e + "f", data, 24 + 4 * k)
                yield number, start + k * step + 1, start + k * step + span, v, KINDS[3], span


class _Blocks(InputPartition):
    def __init__(self, blocks):
        super().__init__(blocks)
        self.blocks = blocks


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chr, self.start = options["path"], options.get("chr"), int(options.get("start", 1))
        self.end = int(options["end"]) if "end" in options else None

    def partitions(self):
        with open(self.path, "rb") as raw:
            w = BigWig(raw)
            number = None
            if self.chr is not None:
                number = next((k for k, (n, _) in w.names().items() if n == self.chr), None)
                if number is None:
                    return [_Blocks([])]
            found = w.blocks(number, self.start, self.end)
        per = max(16, -(-len(found) // 1000))
        return [_Blocks(found[a : a + per]) for a in range(0, len(found), per)] or [_Blocks([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as raw:
            w = BigWig(raw)
            names = {k: n for k, (n, _) in w.names().items()}
            for block in partition.blocks:
                rows = [(names[c], *r) for c, *r in w.rows(*block) if self.chr is None or (names[c] == self.chr and r[1] >= self.start and (self.end is None or r[0] <= self.end))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)


class BigWigSource(DataSource):
    """format("bigwig"): options path, chr, start, end."""

    @classmethod
    def name(cls):
        return "bigwig"

    def schema(self):
        return "chr string, start long, end long, value float, format string, span int"

    def reader(self, schema):
        return _Reader(self.options)


def read_bigwig(spark: SparkSession, path: str, chr: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:  # noqa: A002
    spark.dataSource.register(BigWigSource)
    r = spark.read.format("bigwig").option("path", os.fspath(path))
    for k, x in (("chr", chr), ("start", start), ("end", end)):
        r = r.option(k, str(x)) if x is not None else r
    return r.load()
