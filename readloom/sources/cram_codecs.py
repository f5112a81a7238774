"""CRAM 3.0 primitives: variable-length integers, block compression and the series encodings.

Block methods RAW, GZIP, BZIP2, LZMA and rANS 4x8 are read and written (rANS 4x8 in order 0), those of
cram_codecs31 as well; others raise unless registered.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable

RAW, GZIP, BZIP2, LZMA, RANS = range(5)
METHOD_NAMES = {5: "rANS Nx16", 6: "arithmetic coder", 7: "fqzcomp", 8: "name tokeniser"}


class Cursor:
    """A place in bytes."""

    __slots__ = ("at", "data")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("CRAM data ends too early")
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("CRAM data ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def itf8(self) -> int:
        first = self.byte()
        if first < 0x80:
            return first
        if first < 0xC0:
            return (first & 0x3F) << 8 | self.byte()
        if first < 0xE0:
            return (first & 0x1F) << 16 | int.from_bytes(self.take(2), "big")
        if first < 0xF0:
            return (first & 0x0F) << 24 | int.from_bytes(self.take(3), "big")
        rest = self.take(4)
        value = (first & 0x0F) << 28 | rest[0] << 20 | rest[1] << 12 | rest[2] << 4 | rest[3] & 0x0F
        return value - (1 << 32) if value >> 31 else value

    def ltf8(self) -> int:
        first = self.byte()
        more = 8 if first == 0xFF else next(i for i in range(8) if not first >> (7 - i) & 1)
        high = first & ((1 << max(7 - more, 0)) - 1)
        value = high << 8 * more | int.from_bytes(self.take(more), "big")
        return value - (1 << 64) if more == 8 and value >> 63 else value

    def int32(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def itf8(x: int) -> bytes:
    x &= 0xFFFFFFFF
    if x < 1 << 7:
        return bytes([x])
    if x < 1 << 14:
        return struct.pack(">H", x | 0x8000)
    if x < 1 << 21:
        return (x | 0xC00000).to_bytes(3, "big")
    if x < 1 << 28:
        return struct.pack(">I", x | 0xE0000000)
    return bytes([0xF0 | x >> 28, x >> 20 & 255, x >> 12 & 255, x >> 4 & 255, x & 15])


def ltf8(x: int) -> bytes:
    x &= (1 << 64) - 1
    for more in range(8):
        if x < 1 << (7 * (more + 1)):
            head = (0xFF00 >> more) & 0xFF
            return bytes([head | x >> 8 * more]) + (x & ((1 << 8 * more) - 1)).to_bytes(more, "big")
    return b"\xff" + x.to_bytes(8, "big")


# --- rANS 4x8 ------------------------------------------------------------------------------

_BITS, _LOW = 12, 1 << 23
_TOTAL = 1 << _BITS


def _walk_symbols(c: Cursor):
    """Symbols of a frequency table: runs of successive ones have a count; 0 ends the table."""
    symbol, run = c.byte(), 0
    last = symbol
    while True:
        yield symbol
        if run:
            run -= 1
            symbol += 1
        else:
            symbol = c.byte()
            if symbol == last + 1:
                run = c.byte()
        last = symbol
        if symbol == 0:
            return


def _frequencies(c: Cursor) -> tuple[list[int], list[int], bytes]:
    freq, start, lookup, at = [0] * 256, [0] * 256, bytearray(_TOTAL), 0
    for symbol in _walk_symbols(c):
        f = c.byte()
        if f >= 128:
            f = (f & 127) << 8 | c.byte()
        f = f or _TOTAL
        freq[symbol], start[symbol] = f, at
        lookup[at : at + f] = bytes([symbol]) * f
        at += f
    return freq, start, bytes(lookup)


def rans_decode(data: bytes) -> bytes:
    order, _, n = struct.unpack_from("<BII", data)
    c = Cursor(data, 9)
    if not n:
        return b""
    if order == 0:
        tables = [_frequencies(c)] * 1
        freq, start, lookup = tables[0]
        states, out = list(struct.unpack("<4I", c.take(16))), bytearray(n)
        at = c.at
        for i in range(n):
            x = states[i & 3]
            m = x & (_TOTAL - 1)
            s = lookup[m]
            out[i] = s
            x = freq[s] * (x >> _BITS) + m - start[s]
            while x < _LOW and at < len(data):
                x = x << 8 | data[at]
                at += 1
            states[i & 3] = x
        return bytes(out)
    contexts = {symbol: _frequencies(c) for symbol in _walk_symbols(c)}
    states, out = list(struct.unpack("<4I", c.take(16))), bytearray(n)
    quarter, at, before = n // 4, c.at, [0] * 4
    places = [(j, j * quarter + i) for i in range(quarter) for j in range(4)] + [(3, i) for i in range(4 * quarter, n)]
    for j, i in places:
        freq, start, lookup = contexts[before[j]]
        x = states[j]
        m = x & (_TOTAL - 1)
        s = lookup[m]
        out[i] = before[j] = s
        x = freq[s] * (x >> _BITS) + m - start[s]
        while x < _LOW and at < len(data):
            x = x << 8 | data[at]
            at += 1
        states[j] = x
    return bytes(out)


def rans_encode(data: bytes) -> bytes:
    """Order 0."""
    if not data:
        return struct.pack("<BII", 0, 0, 0)
    counts = [0] * 256
    for b in data:
        counts[b] += 1
    used = [s for s in range(256) if counts[s]]
    freq = [0] * 256
    for s in used:
        freq[s] = max(1, counts[s] * (_TOTAL - 1) // len(data))
    while (over := sum(freq) - (_TOTAL - 1)) > 0:
        s = max(used, key=freq.__getitem__)
        freq[s] -= min(over, freq[s] - 1)
    freq[max(used, key=freq.__getitem__)] += _TOTAL - 1 - sum(freq)
    table, run = bytearray(), 0
    for k, s in enumerate(used):
        if run:
            run -= 1
        else:
            table.append(s)
            if k and used[k - 1] == s - 1:
                while k + run + 1 < len(used) and used[k + run + 1] == s + run + 1:
                    run += 1
                table.append(run)
        table += bytes([freq[s]]) if freq[s] < 128 else struct.pack(">H", freq[s] | 0x8000)
    table.append(0)
    start, at = [0] * 256, 0
    for s in used:
        start[s] = at
        at += freq[s]
    states, out = [_LOW] * 4, bytearray()
    for i in range(len(data) - 1, -1, -1):
        s, x = data[i], states[i & 3]
        most = ((_LOW >> _BITS) << 8) * freq[s]
        while x >= most:
            out.append(x & 255)
            x >>= 8
        states[i & 3] = (x // freq[s] << _BITS) + x % freq[s] + start[s]
    body = bytes(table) + struct.pack("<4I", *states) + bytes(out[::-1])
    return struct.pack("<BII", 0, len(body), len(data)) + body


DECOMPRESS: dict[int, Callable[[bytes], bytes]] = {
    RAW: bytes,
    GZIP: lambda b: zlib.decompress(b, wbits=47),
    BZIP2: bz2.decompress,
    LZMA: lzma.decompress,
    RANS: rans_decode,
}
COMPRESS: dict[int, Callable[[bytes], bytes]] = {
    RAW: bytes,
    GZIP: lambda b: (lambda z: z.compress(b) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31)),
    BZIP2: bz2.compress,
    LZMA: lzma.compress,
    RANS: rans_encode,
}


def register_method(number: int, decompress: Callable[[bytes], bytes], compress: Callable[[bytes], bytes] | None = None) -> None:
    """Adds a block method, of the specification or one's own (numbers over 8)."""
    DECOMPRESS[number] = decompress
    if compress:
        COMPRESS[number] = compress


def decompress(method: int, data: bytes, size: int) -> bytes:
    if method not in DECOMPRESS:
        raise ValueError(f"CRAM block method {METHOD_NAMES.get(method, method)} is not supported")
    out = DECOMPRESS[method](data)
    if len(out) != size:
        raise ValueError("CRAM block has another size than it says")
    return out


# --- encodings -----------------------------------------------------------------------------


class Bits:
    """The core block, read from the highest bit."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            byte = self.at >> 3
            if byte >= len(self.data):
                raise ValueError("CRAM core block ends too early")
            out = out << 1 | self.data[byte] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out


class Encoding:
    """Decoder of one series; core and external blocks are those of the slice at hand."""

    def __init__(self, c: Cursor):
        self.kind, size = c.itf8(), c.itf8()
        p = Cursor(c.take(size))
        self.values: list = []
        if self.kind == 1:  # external
            self.block = p.itf8()
        elif self.kind == 3:  # canonical Huffman
            symbols = [p.itf8() for _ in range(p.itf8())]
            lengths = [p.itf8() for _ in range(p.itf8())]
            self.single = symbols[0] if len(symbols) == 1 and lengths[0] == 0 else None
            self.codes, code, before = {}, 0, 0
            for length, symbol in sorted(zip(lengths, symbols, strict=True)):
                code <<= length - before
                self.codes[length, code] = symbol
                code, before = code + 1, length
        elif self.kind == 4:  # length and bytes have encodings of their own
            self.length, self.bytes_ = Encoding(p), Encoding(p)
        elif self.kind == 5:  # ends at a stop byte
            self.stop, self.block = p.byte(), p.itf8()
        elif self.kind == 6:  # beta: offset, bits
            self.offset, self.width = p.itf8(), p.itf8()
        elif self.kind == 7:  # sub-exponential: offset, k
            self.offset, self.k = p.itf8(), p.itf8()
        elif self.kind == 9:  # Elias gamma
            self.offset = p.itf8()
        elif self.kind != 0:
            raise ValueError(f"CRAM encoding {self.kind} is not supported")

    def number(self, core: Bits, external: dict[int, Cursor]) -> int:
        kind = self.kind
        if kind == 1:
            return external[self.block].itf8()
        if kind == 3:
            if self.single is not None:
                return self.single
            code = length = 0
            while True:
                code, length = code << 1 | core.bits(1), length + 1
                if (symbol := self.codes.get((length, code))) is not None:
                    return symbol
                if length > 31:
                    raise ValueError("invalid CRAM Huffman code")
        if kind == 6:
            return core.bits(self.width) - self.offset
        if kind == 9:
            n = 0
            while not core.bits(1):
                n += 1
            return (1 << n | core.bits(n)) - self.offset
        if kind == 7:
            n = 0
            while core.bits(1):
                n += 1
            value = core.bits(self.k) if n == 0 else 1 << (n + self.k - 1) | core.bits(n + self.k - 1)
            return value - self.offset
        raise ValueError(f"CRAM encoding {kind} holds no numbers")

    def byte(self, core: Bits, external: dict[int, Cursor]) -> int:
        return external[self.block].byte() if self.kind == 1 else self.number(core, external) & 255

    def many(self, n: int, core: Bits, external: dict[int, Cursor]) -> bytes:
        """n bytes of a byte series."""
        return external[self.block].take(n) if self.kind == 1 else bytes(self.byte(core, external) for _ in range(n))

    def array(self, core: Bits, external: dict[int, Cursor]) -> bytes:
        if self.kind == 5:
            c = external[self.block]
            end = c.data.find(self.stop, c.at)
            if end < 0:
                raise ValueError("CRAM array without its end")
            out, c.at = c.data[c.at : end], end + 1
            return out
        if self.kind == 4:
            return self.bytes_.many(self.length.number(core, external), core, external)
        raise ValueError(f"CRAM encoding {self.kind} holds no arrays")


def external(block: int) -> bytes:
    p = itf8(block)
    return itf8(1) + itf8(len(p)) + p


def array_stop(stop: int, block: int) -> bytes:
    p = bytes([stop]) + itf8(block)
    return itf8(5) + itf8(len(p)) + p


def array_length(length_block: int, bytes_block: int) -> bytes:
    p = external(length_block) + external(bytes_block)
    return itf8(4) + itf8(len(p)) + p
