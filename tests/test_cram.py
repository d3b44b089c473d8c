"""CRAM: numbers, encodings, codecs and files."""

import random
import struct

import pytest

from strandwise.sources import binary, cram, indexed, rans, text


def test_numbers():
    for x in (0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 31) - 1, -1, -2):
        assert cram.itf8(b"\0" + cram.put_itf8(x), 1) == (x, 1 + len(cram.put_itf8(x)))
    for x in (0, 127, 128, 1 << 14, 1 << 21, 1 << 35, 1 << 42, (1 << 56) - 1, 1 << 56, (1 << 63) - 1, -1):
        assert cram.ltf8(cram.put_ltf8(x), 0) == (x, len(cram.put_ltf8(x)))
    assert [len(cram.put_ltf8(1 << 7 * k)) for k in range(9)] == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_rans():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 1000, 4003):
        for kinds in (1, 3, 40, 256):
            data = bytes(rng.randrange(kinds) + (0 if kinds == 256 else 60) for _ in range(n))
            for order in (0, 1):
                assert rans.decode(rans.encode(data, order)) == data


def test_blocks():
    data = b"abcabcabc" * 50
    for method in range(5):
        raw = cram.pack_block(4, 7, data, (method,))
        assert raw[0] == method and cram.read_block(raw, 0) == (4, 7, data, len(raw))
    with pytest.raises(ValueError, match="damaged"):
        cram.read_block(raw[:-1] + bytes([raw[-1] ^ 1]), 0)


def bits(text):
    text = text.replace(" ", "")
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


@pytest.mark.parametrize(
    "codec, parameters, core, values",
    [
        (3, bytes([3, 65, 66, 67, 3, 1, 2, 2]), "0 10 11 0", [65, 66, 67, 65]),  # Huffman
        (3, bytes([1, 9, 1, 0]), "", [9, 9]),
        (6, bytes([2, 4]), "0101 1111", [3, 13]),  # beta
        (9, bytes([1]), "1 010 00101", [0, 1, 4]),  # gamma
        (7, bytes([0, 2]), "0 11 10 01 110 101", [3, 5, 13]),  # subexponential
        (8, bytes([0, 2]), "0 11 10 01", [3, 5]),  # Golomb-Rice
        (2, bytes([0, 5]), "0 00 10 110 0 111", [0, 8, 4]),  # Golomb
    ],
)
def test_encodings(codec, parameters, core, values):
    read, _ = cram.decoder(bytes([codec, len(parameters)]) + parameters, 0, "int")
    s = cram._Slice(bits(core) if core else b"", {})
    assert [read(s) for _ in values] == values


def test_features_restore_reads():
    raw = cram._map([b"SM\x1b\x1b\x1b\x1b\x1b"]) + cram._map([]) + cram._map([])
    c = cram.Compression(raw)
    reference = b"ACGTACGTACGTACGT"
    bases_of = lambda start, n: reference[start - 1 : start - 1 + n]
    # A has the codes 0: C, 1: G, 2: T, 3: N
    seq, ops, quals, end = cram._sequence([(1, "S", b"TT"), (4, "X", 1), (6, "D", 2), (6, "I", b"GG"), (8, "i", b"C"), (10, "B", (65, 30)), (11, "Q", 12)], 11, 4, bases_of, c)
    assert (seq, [tuple(x) for x in ops], quals, end) == (b"TTTGCGGCAAG", [(2, "S"), (3, "M"), (2, "D"), (3, "I"), (3, "M")], {9: 30, 10: 12}, 11)


def test_mates_in_a_slice():
    row = lambda flag, pos, end, mate: {"mate": mate, "nref": -1, "npos": 0, "tlen": 0, "name": None, "flag": flag, "ref": 0, "pos": pos, "end": end}
    rows = [row(65, 10, 20, 2), row(0, 12, 13, None), row(145, 30, 45, None)]
    cram._resolve_mates(rows, 100)
    assert [(r["name"], r["flag"], r["nref"], r["npos"], r["tlen"]) for r in rows] == [("100", 97, 0, 30, 36), ("101", 0, -1, 0, 0), ("100", 145, 0, 10, -36)]


def test_files(spark, tmp_path):
    rng = random.Random(7)
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, options array<struct<tag:string,type:string,value:string>>, ordinal long"
    rows, at = [], 1
    for i in range(1200):
        at = 1 if i % 400 == 0 else at + rng.randint(0, 9)
        cigar, n = rng.choice([("10M", 10), ("3S7M", 10), ("4M2I4M", 10), ("5M3D5M", 10), ("4M20N6M", 10), ("2H8M1P1M", 9)])
        placed = i < 1150
        seq = "".join(rng.choice("ACGTN") for _ in range(n)) if i % 50 else "*"
        qual = "".join(chr(33 + rng.randint(0, 60)) for _ in range(n)) if i % 7 and seq != "*" else "*"
        options = [("RG", "Z", "g1"), ("NM", "i", str(i))] if i % 3 else [("XB", "B", "S,1,70"), ("XA", "A", "q")] if i % 2 else []
        rows.append((f"r{i}", (99 if i % 2 else 147) if placed else 4, f"c{i // 400}" if placed else "*", at if placed else 0, 30 if placed else 0, cigar if placed else "*", "=" if placed else "*", 5 if placed else 0, -7 if placed else 0, seq, qual, options, i))
    df = spark.createDataFrame(rows, schema).repartitionByRange(3, "ordinal").sortWithinPartitions("ordinal")
    header = {"HD": {"VN": "1.6", "SO": "coordinate"}, "SQ": [{"SN": f"c{k}", "LN": 10_000} for k in range(3)], "RG": [{"ID": "g0"}, {"ID": "g1"}]}
    key = lambda r: (*r[:11], sorted(tuple(o) for o in r[11]))
    for name, head in (("sorted", header), ("mixed", header | {"HD": {"VN": "1.6", "SO": "unsorted"}})):
        path = f"{tmp_path}/{name}.cram"
        cram.write_cram(df, path, head, index=True, records=90, methods={"RN": (cram.LZMA,), "BB": (cram.BZIP2,), "QS": (cram.RANS,)})
        assert cram.cram_header(path) == head
        got = cram.read_cram(spark, path).orderBy("ordinal").collect()
        assert [key(r) for r in got] == [key(r) for r in rows]
        made = indexed.read_crai(path + ".crai")
        assert cram.build_crai(path) == path + ".crai" and indexed.read_crai(path + ".crai") == made
        spans = [(r[2], r[3], r[3] + max(sum(int(n) for n, o in binary._cigar(r[5]) if o in "MDN"), 1) - 1) for r in rows]
        for indexed_read in (True, False):
            if not indexed_read:
                (tmp_path / f"{name}.cram.crai").unlink()
            for chrom, start, end in (("c1", 500, 700), ("c2", None, None), ("c0", 1, 1), ("*", None, None), ("c9", None, None)):
                got = cram.read_cram(spark, path, chr=chrom, start=start, end=end).count()
                assert got == sum(c == chrom and (chrom == "*" or (e >= (start or 1) and p <= (end or p))) for c, p, e in spans)
    raw = open(path, "rb").read()
    assert raw.endswith(cram.END) and text.file_type_of(raw[:4]) == "cram" and struct.unpack_from("<I", cram.END[-4:])[0]
