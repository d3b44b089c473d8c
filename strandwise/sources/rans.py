"""rANS with four interleaved 32-bit states and 12-bit frequencies, of order 0 and 1, as CRAM 3.0 has it."""

from __future__ import annotations

import struct

_LOW, _BITS = 1 << 23, 12
_TOTAL = 1 << _BITS


def _read_table(data: bytes, k: int) -> tuple[list[int], int]:
    freq, symbol, run = [0] * 256, data[k], 0
    k += 1
    while True:
        f = data[k]
        k += 1
        if f >= 128:
            f, k = (f & 127) << 8 | data[k], k + 1
        freq[symbol] = f or _TOTAL
        if run:
            run, symbol = run - 1, symbol + 1
        elif data[k] == symbol + 1:
            symbol, run, k = data[k], data[k + 1], k + 2
        else:
            symbol, k = data[k], k + 1
        if not symbol:
            return freq, k


def _write_table(freq: list[int]) -> bytes:
    out, run = bytearray(), 0
    for s in range(256):
        if not freq[s]:
            continue
        if run:
            run -= 1
        else:
            out.append(s)
            if s and freq[s - 1]:
                end = s
                while end + 1 < 256 and freq[end + 1]:
                    end += 1
                run = end - s
                out.append(run)
        f = freq[s]
        out += bytes([128 | f >> 8, f & 255]) if f >= 128 else bytes([f])
    out.append(0)
    return bytes(out)


def _lookup(freq: list[int]) -> tuple[bytes, list[int]]:
    """(symbol of each of the slots, first slot of each symbol)."""
    slots, first, at = bytearray(), [0] * 256, 0
    for s, f in enumerate(freq):
        first[s] = at
        slots += bytes([s]) * f
        at += f
    return bytes(slots).ljust(_TOTAL, b"\0"), first


def _scaled(counts: list[int]) -> list[int]:
    """Counts that add up to 4095, none of which falls to zero."""
    total = sum(counts)
    out = [max(1, c * 4095 // total) if c else 0 for c in counts]
    out[max(range(256), key=lambda s: out[s])] += 4095 - sum(out)
    if min((f for f in out if f), default=1) < 1 or max(out) < 1:
        raise ValueError("frequencies don't fit")
    return out


def decode(data: bytes) -> bytes:
    order, _, n = struct.unpack_from("<BII", data)
    if not n:
        return b""
    return (_decode1 if order else _decode0)(data, 9, n)


def _decode0(data: bytes, k: int, n: int) -> bytes:
    freq, k = _read_table(data, k)
    slots, first = _lookup(freq)
    states, k, out = list(struct.unpack_from("<4I", data, k)), k + 16, bytearray(n)
    for i in range(n):
        r = states[i & 3]
        m = r & 4095
        s = slots[m]
        out[i] = s
        r = freq[s] * (r >> _BITS) + m - first[s]
        while r < _LOW and k < len(data):
            r, k = r << 8 | data[k], k + 1
        states[i & 3] = r
    return bytes(out)


def _decode1(data: bytes, k: int, n: int) -> bytes:
    tables: dict[int, tuple] = {}
    context, run = data[k], 0
    k += 1
    while True:
        freq, k = _read_table(data, k)
        tables[context] = (freq, *_lookup(freq))
        if run:
            run, context = run - 1, context + 1
        elif data[k] == context + 1:
            context, run, k = data[k], data[k + 1], k + 2
        else:
            context, k = data[k], k + 1
        if not context:
            break
    states, k = list(struct.unpack_from("<4I", data, k)), k + 16
    quarter, out, last = n // 4, bytearray(n), [0] * 4

    def step(j: int, at: int) -> None:
        nonlocal k
        freq, slots, first = tables[last[j]]
        r = states[j]
        m = r & 4095
        s = slots[m]
        out[at] = last[j] = s
        r = freq[s] * (r >> _BITS) + m - first[s]
        while r < _LOW and k < len(data):
            r, k = r << 8 | data[k], k + 1
        states[j] = r

    for i in range(quarter):
        for j in range(4):
            step(j, i + j * quarter)
    for at in range(4 * quarter, n):
        step(3, at)
    return bytes(out)


def encode(data: bytes, order: int = 0) -> bytes:
    n = len(data)
    if order and n < 4:
        order = 0
    if not n:
        return struct.pack("<BII", order, 0, 0)
    body = _encode1(data) if order else _encode0(data)
    return struct.pack("<BII", order, len(body), n) + body


def _put(states: list[int], j: int, freq: int, first: int, out: bytearray) -> None:
    r, most = states[j], ((_LOW >> _BITS) << 8) * freq
    while r >= most:
        out.append(r & 255)
        r >>= 8
    states[j] = (r // freq << _BITS) + r % freq + first


def _encode0(data: bytes) -> bytes:
    counts = [0] * 256
    for s in data:
        counts[s] += 1
    freq = _scaled(counts)
    _, first = _lookup(freq)
    states, out = [_LOW] * 4, bytearray()
    for i in range(len(data) - 1, -1, -1):
        _put(states, i & 3, freq[data[i]], first[data[i]], out)
    return _write_table(freq) + struct.pack("<4I", *states) + bytes(out[::-1])


def _encode1(data: bytes) -> bytes:
    n, quarter = len(data), len(data) // 4
    starts = [0, quarter, 2 * quarter, 3 * quarter]
    counts: dict[int, list[int]] = {}
    for i in range(n):
        counts.setdefault(0 if i in starts else data[i - 1], [0] * 256)[data[i]] += 1
    freqs = {c: _scaled(x) for c, x in counts.items()}
    firsts = {c: _lookup(f)[1] for c, f in freqs.items()}
    states, out = [_LOW] * 4, bytearray()

    def put(j: int, at: int) -> None:
        c = 0 if at in starts else data[at - 1]
        _put(states, j, freqs[c][data[at]], firsts[c][data[at]], out)

    for at in range(n - 1, 4 * quarter - 1, -1):
        put(3, at)
    for i in range(quarter - 1, -1, -1):
        for j in (3, 2, 1, 0):
            put(j, i + j * quarter)
    head, run = bytearray(), 0
    for c in range(256):
        if c not in freqs:
            continue
        if run:
            run -= 1
        else:
            head.append(c)
            if c and c - 1 in freqs:
                end = c
                while end + 1 in freqs:
                    end += 1
                run = end - c
                head.append(run)
        head += _write_table(freqs[c])
    head.append(0)
    return bytes(head) + struct.pack("<4I", *states) + bytes(out[::-1])
