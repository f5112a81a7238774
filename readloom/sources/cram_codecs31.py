"""Block methods of CRAM 3.1: rANS Nx16 (5) and the adaptive arithmetic coder (6).

Both share the outer transforms: STRIPE (bytes dealt over streams of their own), PACK (few symbols to a
byte), RLE (runs) and CAT (stored). Values are stored in groups of seven bits, highest first.

Blocks of rANS over a few KB are written as many streams of order 0 with 32 states each, so that numpy takes a step of all
states of all streams at once. That gives up contexts of order 1, which some data would compress better with.
"""

from __future__ import annotations

import bz2
import struct
from collections import Counter, defaultdict

import numpy as np

from readloom.sources.cram_codecs import DECOMPRESS, Cursor, _walk_symbols, register_method

NX16, ARITHMETIC = 5, 6
# Fixed values of the formats: flags, precision and bounds.
ORDER1, X32, STRIPE, NO_SIZE, CAT, RLE, PACK = 1, 4, 8, 16, 32, 64, 128
EXTERNAL = 4
BITS, LOW = 12, 1 << 15
STEP, MOST = 16, (1 << 16) - 17
TOP, BOTTOM = (1 << 32) - 1, 1 << 24
RUN_MODELS, RUN_SYMBOLS = 258, 4
#: States of a stream with the flag X32, and the size of the streams that a block is dealt over.
WAYS, STREAM_BYTES = 32, 2048


def uint7(x: int) -> bytes:
    out = [x & 127]
    while x := x >> 7:
        out.append(x & 127 | 128)
    return bytes(reversed(out))


def read7(c: Cursor) -> int:
    value = 0
    while True:
        b = c.byte()
        value = value << 7 | b & 127
        if b < 128:
            return value


# --- transforms ----------------------------------------------------------------------------


def _width(symbols: int) -> int:
    """Bits of a packed symbol."""
    return 0 if symbols <= 1 else 1 if symbols <= 2 else 2 if symbols <= 4 else 4


def pack(data: bytes) -> tuple[bytes, bytes] | None:
    """Meta data and packed bytes, or None for over 16 symbols."""
    symbols = np.flatnonzero(np.bincount(np.frombuffer(data, np.uint8), minlength=256)).tolist()
    if len(symbols) > 16:
        return None
    return _packed(np.frombuffer(data, np.uint8), symbols)


def _packed(flat: np.ndarray, symbols: list[int]) -> tuple[bytes, bytes]:
    """Meta data and packed bytes of data that has no other symbols."""
    width, out = _width(len(symbols)), b""
    if width:
        each, code = 8 // width, np.zeros(256, np.uint8)
        code[symbols] = range(len(symbols))
        places = np.zeros(-(-len(flat) // each) * each, np.uint8)
        places[: len(flat)] = code[flat]
        out = np.bitwise_or.reduce(places.reshape(-1, each) << np.arange(0, 8, width, dtype=np.uint8), axis=1).tobytes()
    return bytes([len(symbols), *symbols]) + uint7(len(out)), out


def unpack(data: bytes, symbols: bytes, n: int) -> bytes:
    width = _width(len(symbols))
    if not width:
        return symbols[:1] * n
    each = 8 // width
    named = np.zeros(1 << width, np.uint8)
    named[: len(symbols)] = list(symbols)
    table = named[np.arange(256)[:, None] >> np.arange(0, 8, width) & (1 << width) - 1]
    if len(data) * each < n:
        raise ValueError("CRAM block has too few packed bytes")
    return table[np.frombuffer(data, np.uint8)].tobytes()[:n]


def runs(data: bytes) -> tuple[bytes, bytes]:
    """Meta data (symbols with runs, run lengths) and literals."""
    pieces, at = [], 0
    while at < len(data):
        end = at + 1
        while end < len(data) and data[end] == data[at]:
            end += 1
        pieces.append((data[at], end - at))
        at = end
    gain = Counter()
    for s, n in pieces:
        gain[s] += n - 2
    listed = sorted(s for s, g in gain.items() if g > 0)
    if not listed:
        listed = sorted(gain)[:1]
    meta, literals = bytearray([len(listed) & 255, *listed]), bytearray()
    for s, n in pieces:
        if s in listed:
            literals.append(s)
            meta += uint7(n - 1)
        else:
            literals += bytes([s]) * n
    return bytes(meta), bytes(literals)


def expand(literals: bytes, meta: Cursor, n: int) -> bytes:
    count = meta.byte() or 256
    listed, out = set(meta.take(count)), bytearray()
    for s in literals:
        out += bytes([s]) * (read7(meta) + 1 if s in listed else 1)
    if len(out) != n:
        raise ValueError("CRAM block has wrong run lengths")
    return bytes(out)


def _dealt(c: Cursor, n: int, decode) -> bytes:
    streams = c.byte()
    sizes = [read7(c) for _ in range(streams)]
    out = bytearray(n)
    for k, size in enumerate(sizes):
        out[k::streams] = decode(c.take(size), n // streams + (n % streams > k))
    return bytes(out)


def _deal(data: bytes, streams: int, encode) -> bytes:
    coded = [encode(data[k::streams]) for k in range(streams)]
    return bytes([streams]) + b"".join(uint7(len(x)) for x in coded) + b"".join(coded)


# --- rANS Nx16 -----------------------------------------------------------------------------


class _Table:
    """Frequencies of one context, scaled to a power of two."""

    def __init__(self, freq: dict[int, int], bits: int):
        total, shift = sum(freq.values()), 0
        while 0 < total << shift < 1 << bits:
            shift += 1
        self.freq = {s: f << shift for s, f in freq.items()}
        self.start, self.lookup, at = {}, bytearray(1 << bits), 0
        for s in sorted(self.freq):
            self.start[s] = at
            self.lookup[at : at + self.freq[s]] = bytes([s]) * self.freq[s]
            at += self.freq[s]
        if at > 1 << bits:
            raise ValueError("CRAM frequencies are too large")


def _step(table: _Table, x: int, bits: int, data: bytes, at: int) -> tuple[int, int, int]:
    """Symbol, next state and place."""
    m = x & (1 << bits) - 1
    s = table.lookup[m]
    x = table.freq[s] * (x >> bits) + m - table.start[s]
    if x < LOW:
        x, at = x << 16 | data[at] | data[at + 1] << 8, at + 2
    return s, x, at


def _order0(c: Cursor, n: int, ways: int) -> bytes:
    symbols = list(_walk_symbols(c))
    table = _Table({s: read7(c) for s in symbols}, BITS)
    states, data, at, out = list(struct.unpack(f"<{ways}I", c.take(4 * ways))), c.data + b"\0\0", c.at, bytearray(n)
    for i in range(n):
        out[i], states[i % ways], at = _step(table, states[i % ways], BITS, data, at)
    return bytes(out)


def _contexts(c: Cursor, bits: int) -> dict[int, _Table]:
    symbols, out = list(_walk_symbols(c)), {}
    for a in symbols:
        freq, zeros = {}, 0
        for b in symbols:
            if zeros:
                zeros -= 1
                continue
            f = read7(c)
            if f:
                freq[b] = f
            else:
                zeros = c.byte()
        out[a] = _Table(freq, bits)
    return out


def _order1(c: Cursor, n: int, ways: int) -> bytes:
    kind = c.byte()
    bits = kind >> 4
    if kind & 1:
        size, packed = read7(c), read7(c)
        tables = _contexts(Cursor(_order0(Cursor(c.take(packed)), size, 4)), bits)
    else:
        tables = _contexts(c, bits)
    states, data, at, out = list(struct.unpack(f"<{ways}I", c.take(4 * ways))), c.data + b"\0\0", c.at, bytearray(n)
    share, before = n // ways, [0] * ways
    places = [(j, j * share + i) for i in range(share) for j in range(ways)] + [(ways - 1, i) for i in range(ways * share, n)]
    for j, i in places:
        out[i], states[j], at = _step(tables[before[j]], states[j], bits, data, at)
        before[j] = out[i]
    return bytes(out)


def nx16_decode(data: bytes, n: int | None = None) -> bytes:
    """n: the size where the stream doesn't say it."""
    c = Cursor(data)
    flags = c.byte()
    if not flags & NO_SIZE:
        n = read7(c)
    if n is None:
        raise ValueError("rANS stream of unknown size")
    if flags & STRIPE:
        at, out = c.at, _dealt_at_once(c, n)
        if out is None:
            c.at = at
            out = _dealt(c, n, nx16_decode)
        return out
    ways, whole, symbols, meta = 32 if flags & X32 else 4, n, b"", None
    if flags & PACK:
        symbols = c.take(c.byte())
        n = read7(c)
    unpacked = n
    if flags & RLE:
        size, literals = read7(c), read7(c)
        meta = Cursor(c.take(size >> 1) if size & 1 else _order0(Cursor(c.take(read7(c))), size >> 1, ways))
        n = literals
    if flags & CAT:
        out = c.take(n)
    elif n == 0:
        out = b""
    else:
        out = (_order1 if flags & ORDER1 else _order0)(c, n, ways)
    if meta is not None:
        out = expand(out, meta, unpacked)
    return unpack(out, symbols, whole) if flags & PACK else out


def _scaled(counts: Counter, bits: int) -> dict[int, int]:
    """Frequencies of sum 2 ** bits, none of them zero."""
    total, n = 1 << bits, sum(counts.values())
    freq = {s: max(1, c * total // n) for s, c in counts.items()}
    while (over := sum(freq.values()) - total) > 0:
        s = max(freq, key=freq.__getitem__)
        freq[s] -= min(over, freq[s] - 1)
    freq[max(freq, key=freq.__getitem__)] += total - sum(freq.values())
    return freq


def _alphabet(symbols: list[int]) -> bytes:
    out, run = bytearray(), 0
    for k, s in enumerate(symbols):
        if run:
            run -= 1
            continue
        out.append(s)
        if k and symbols[k - 1] == s - 1:
            while k + run + 1 < len(symbols) and symbols[k + run + 1] == s + run + 1:
                run += 1
            out.append(run)
    return bytes(out) + b"\0"


def _coded(steps: list[tuple[_Table, int, int]], ways: int, bits: int) -> bytes:
    """States and 16-bit words of (table, symbol, way) in decoding order."""
    states, out = [LOW] * ways, []
    for table, s, j in reversed(steps):
        x, f = states[j], table.freq[s]
        if x >= (LOW >> bits << 16) * f:
            out.append(x & 0xFFFF)
            x >>= 16
        states[j] = (x // f << bits) + x % f + table.start[s]
    return struct.pack(f"<{ways}I", *states) + struct.pack(f"<{len(out)}H", *reversed(out))


def _encode0(data: bytes, ways: int) -> bytes:
    freq = _scaled(Counter(data), BITS)
    table = _Table(freq, BITS)
    head = _alphabet(sorted(freq)) + b"".join(uint7(freq[s]) for s in sorted(freq))
    return head + _coded([(table, s, i % ways) for i, s in enumerate(data)], ways, BITS)


def _encode1(data: bytes, ways: int) -> bytes:
    share, n = len(data) // ways, len(data)
    places = [(j, j * share + i) for i in range(share) for j in range(ways)] + [(ways - 1, i) for i in range(ways * share, n)]
    counts: dict[int, Counter] = defaultdict(Counter)
    before, pairs = [0] * ways, []
    for j, i in places:
        counts[before[j]][data[i]] += 1
        pairs.append((before[j], data[i], j))
        before[j] = data[i]
    symbols = sorted({0, *data})
    tables, head = {}, bytearray(_alphabet(symbols))
    for a in symbols:
        freq = _scaled(counts[a], BITS) if a in counts else {}
        tables[a] = _Table(freq, BITS)
        k = 0
        while k < len(symbols):
            f = freq.get(symbols[k], 0)
            head += uint7(f)
            k += 1
            if not f:
                zeros = 0
                while k < len(symbols) and symbols[k] not in freq and zeros < 255:
                    zeros, k = zeros + 1, k + 1
                head.append(zeros)
    packed = _encode0(bytes(head), 4)
    table = bytes([BITS << 4]) + head
    if len(packed) + 8 < len(head):
        table = bytes([BITS << 4 | 1]) + uint7(len(head)) + uint7(len(packed)) + packed
    return table + _coded([(tables[a], s, j) for a, s, j in pairs], ways, BITS)


def nx16_encode(data: bytes, flags: int = 0, streams: int = 4) -> bytes:
    """flags: wanted transforms; those that can't be or don't pay are left out."""
    if flags & STRIPE:
        inner = flags & ~STRIPE
        return bytes([STRIPE]) + uint7(len(data)) + _deal(data, streams, lambda x: nx16_encode(x, inner))
    ways, head, size = 32 if flags & X32 else 4, b"", len(data)
    if flags & PACK:
        packed = pack(data) if data else None
        if packed is None:
            flags &= ~PACK
        else:
            head, data = packed
    if flags & RLE:
        if not data:
            flags &= ~RLE
        else:
            meta, data = runs(data)
            head += uint7(len(meta) << 1 | 1) + uint7(len(data)) + meta
    if len(data) < ways or flags & CAT:
        flags, body = flags & ~ORDER1 | CAT, data
    else:
        body = (_encode1 if flags & ORDER1 else _encode0)(data, ways)
    return bytes([flags & ~NO_SIZE]) + uint7(size) + head + body


# --- many streams at once ------------------------------------------------------------------


def _code_at_once(streams: list[np.ndarray], freq: dict[int, int]) -> list[bytes]:
    """States and words of streams of order 0 with 32 states each and the same frequencies."""
    f, start = np.ones(256, np.uint32), np.zeros(256, np.uint32)
    at = 0
    for s in sorted(freq):
        f[s], start[s] = freq[s], at
        at += freq[s]
    least, more = f << (15 - BITS + 16), (1 << BITS) - f
    sizes = np.array([len(x) for x in streams])
    steps, all_busy = -(-int(sizes.max()) // WAYS), int(sizes.min()) // WAYS
    data = np.zeros((len(streams), steps * WAYS), np.uint8)
    for k, x in enumerate(streams):
        data[k, : len(x)] = x
    data = np.ascontiguousarray(data.reshape(len(streams), steps, WAYS).transpose(1, 0, 2))
    x = np.full((len(streams), WAYS), LOW, np.uint32)
    given, words = np.empty(data.shape, bool), np.empty(data.shape, np.uint16)
    for t in range(steps - 1, -1, -1):
        s = data[t]
        out = x >= least.take(s)
        words[t] = x & 0xFFFF
        if t >= all_busy:
            busy = t * WAYS + np.arange(WAYS) < sizes[:, None]
            out &= busy
        given[t] = out
        low = np.where(out, x >> 16, x)
        new = low + low // f.take(s) * more.take(s) + start.take(s)
        x = np.where(busy, new, x) if t >= all_busy else new
    given, words = given.transpose(1, 0, 2).reshape(len(streams), -1), words.transpose(1, 0, 2).reshape(len(streams), -1)
    flat, ends = words[given].astype("<u2").tobytes(), [0, *np.cumsum(2 * given.sum(axis=1)).tolist()]
    states = x.astype("<u4")
    return [states[k].tobytes() + flat[ends[k] : ends[k + 1]] for k in range(len(streams))]


def nx16_many(data: bytes, stream_bytes: int = STREAM_BYTES) -> bytes:
    """The data as many streams, packed if there are few symbols; stored if that is not smaller."""
    flat = np.frombuffer(data, np.uint8)
    counts = np.bincount(flat, minlength=256)
    symbols = np.flatnonzero(counts).tolist()
    packed = len(symbols) <= 16
    if len(symbols) <= 1:
        return nx16_encode(data, PACK)
    each = 8 // _width(len(symbols)) if packed else 1
    n = min(max(len(data) // each // stream_bytes, 2), 255)
    streams, heads = [flat[k::n] for k in range(n)], [b""] * n
    sizes = [len(x) for x in streams]
    if packed:
        coded = [_packed(x, symbols) for x in streams]
        heads, streams = [head for head, _ in coded], [np.frombuffer(body, np.uint8) for _, body in coded]
        counts = np.bincount(np.concatenate(streams), minlength=256)
    if min(map(len, streams)) < WAYS:
        return nx16_encode(data, PACK)
    used = np.flatnonzero(counts).tolist()
    freq = _scaled(Counter({s: int(counts[s]) for s in used}), BITS)
    table = _alphabet(used) + b"".join(uint7(freq[s]) for s in used)
    bits = -sum(counts[s] * np.log2(freq[s] / (1 << BITS)) for s in used)
    if bits / 8 + n * (len(table) + len(heads[0]) + 4 * WAYS) >= len(data):
        return nx16_encode(data, CAT)
    flags = bytes([X32 | (PACK if packed else 0)])
    parts = [flags + uint7(size) + head + table + body for size, head, body in zip(sizes, heads, _code_at_once(streams, freq), strict=True)]
    return bytes([STRIPE]) + uint7(len(data)) + bytes([n]) + b"".join(uint7(len(x)) for x in parts) + b"".join(parts)


def _dealt_at_once(c: Cursor, n: int) -> bytes | None:
    """The data of streams of order 0 with 32 states and no transform but PACK; None for others."""
    count = c.byte()
    parts = [c.take(size) for size in [read7(c) for _ in range(count)]]
    if count < 2 or any(not x or x[0] & ~PACK != X32 for x in parts):
        return None
    packs, sizes, states, ends, tables, which = [], [], [], [], {}, []
    text = b""
    for k, part in enumerate(parts):
        p = Cursor(part, 1)
        whole = read7(p)
        if whole != n // count + (n % count > k):
            return None
        symbols = p.take(p.byte()) if part[0] & PACK else None
        size = read7(p) if symbols is not None else whole
        if not size:
            return None
        if not (text and part.startswith(text, p.at)):
            at = p.at
            freq = {s: read7(p) for s in list(_walk_symbols(p))}
            text = part[at : p.at]
            if text not in tables:
                made = _Table(freq, BITS)
                if sum(made.freq.values()) != 1 << BITS:
                    return None
                tables[text] = len(tables), made
        else:
            p.at += len(text)
        which.append(tables[text][0])
        packs.append((symbols, whole))
        sizes.append(size)
        states.append(np.frombuffer(p.take(4 * WAYS), "<u4"))
        ends.append(part[p.at :])
    symbol = np.concatenate([np.frombuffer(t.lookup, np.uint8) for _, t in tables.values()])
    f = np.concatenate([np.array([t.freq.get(s, 0) for s in range(256)], np.uint32)[np.frombuffer(t.lookup, np.uint8)] for _, t in tables.values()])
    start = np.concatenate([np.array([t.start.get(s, 0) for s in range(256)], np.uint32)[np.frombuffer(t.lookup, np.uint8)] for _, t in tables.values()])
    more = np.tile(np.arange(1 << BITS, dtype=np.uint32), len(tables)) - start
    offset = (np.array(which, np.uint32) << BITS)[:, None] if len(tables) > 1 else None
    if any(len(x) % 2 for x in ends):
        return None
    words = np.frombuffer(b"".join(ends), "<u2").astype(np.uint32)
    if not len(words):
        words = np.zeros(1, np.uint32)
    at = np.cumsum([0, *(len(x) // 2 for x in ends)])[:-1].astype(np.int64) - 1
    x = np.array(states, np.uint32)
    steps = -(-max(sizes) // WAYS)
    out = np.empty((steps, count, WAYS), np.uint8)
    for t in range(steps):
        m = x & (1 << BITS) - 1
        if offset is not None:
            m |= offset
        out[t] = symbol.take(m)
        x = f.take(m) * (x >> BITS) + more.take(m)
        low = x < LOW
        turn = low.cumsum(axis=1)
        place = turn + at[:, None]
        x = np.where(low, x << 16 | words.take(place, mode="clip"), x)
        at = place[:, -1]
    flat = out.transpose(1, 0, 2).reshape(count, -1)
    whole = np.empty(n, np.uint8)
    for k, ((symbols, size), packed) in enumerate(zip(packs, sizes, strict=True)):
        data = flat[k, :packed]
        whole[k::count] = data if symbols is None else np.frombuffer(unpack(data.tobytes(), symbols, size), np.uint8)
    return whole.tobytes()


# --- adaptive arithmetic coder -------------------------------------------------------------


class _Model:
    """Adaptive frequencies; a symbol that overtakes the one before it changes places with it."""

    __slots__ = ("freq", "symbols", "total")

    def __init__(self, n: int):
        self.symbols, self.freq, self.total = list(range(n)), [1] * n, n

    def met(self, k: int) -> None:
        freq = self.freq
        freq[k] += STEP
        self.total += STEP
        if self.total > MOST:
            self.freq = freq = [f - (f >> 1) for f in freq]
            self.total = sum(freq)
        if k and freq[k] > freq[k - 1]:
            freq[k], freq[k - 1] = freq[k - 1], freq[k]
            self.symbols[k], self.symbols[k - 1] = self.symbols[k - 1], self.symbols[k]


class _Decoder:
    def __init__(self, c: Cursor):
        self.c, self.range = c, TOP
        self.code = int.from_bytes(c.take(5), "big") & TOP

    def symbol(self, model: _Model) -> int:
        unit = self.range // model.total
        wanted, k, low = self.code // unit, 0, 0
        while k < len(model.freq) - 1 and low + model.freq[k] <= wanted:
            low += model.freq[k]
            k += 1
        self.code -= low * unit
        self.range = unit * model.freq[k]
        while self.range < BOTTOM:
            self.range <<= 8
            self.code = (self.code << 8 | (self.c.byte() if self.c.at < len(self.c.data) else 0)) & TOP
        s = model.symbols[k]
        model.met(k)
        return s


class _Encoder:
    def __init__(self):
        self.low, self.range, self.held, self.waiting, self.out = 0, TOP, 0, 0, bytearray()

    def symbol(self, model: _Model, s: int) -> None:
        k = model.symbols.index(s)
        unit = self.range // model.total
        self.low += sum(model.freq[:k]) * unit
        self.range = unit * model.freq[k]
        while self.range < BOTTOM:
            self.range <<= 8
            self.shift()
        model.met(k)

    def shift(self) -> None:
        """Puts out the highest byte; bytes of 255 wait for a carry."""
        carry = self.low >> 32
        if carry or self.low < 0xFF000000:
            self.out.append(self.held + carry & 255)
            self.out += bytes([255 + carry & 255]) * self.waiting
            self.held, self.waiting = self.low >> 24 & 255, 0
        else:
            self.waiting += 1
        self.low = self.low << 8 & TOP

    def finish(self) -> bytes:
        for _ in range(5):
            self.shift()
        return bytes(self.out)


def _models(order1: bool, symbols: int):
    """The model of the symbol after a given one."""
    if order1:
        found: dict[int, _Model] = {}
        return lambda before: found.get(before) or found.setdefault(before, _Model(symbols))
    one = _Model(symbols)
    return lambda before: one


def _plain(c: Cursor, n: int, flags: int) -> bytes:
    model = _models(bool(flags & ORDER1), c.byte() or 256)
    coder, out, before = _Decoder(c), bytearray(), 0
    lengths = [_Model(RUN_SYMBOLS) for _ in range(RUN_MODELS)] if flags & RLE else None
    while len(out) < n:
        before = coder.symbol(model(before))
        times = 1
        if lengths:
            at, part = before, RUN_SYMBOLS - 1
            while part == RUN_SYMBOLS - 1:
                part = coder.symbol(lengths[at])
                times += part
                at = 256 if at < 256 else 257
        out += bytes([before]) * times
    return bytes(out[:n])


def _coded_plain(data: bytes, flags: int) -> bytes:
    symbols = max(data) + 1
    model, coder, before, at = _models(bool(flags & ORDER1), symbols), _Encoder(), 0, 0
    lengths = [_Model(RUN_SYMBOLS) for _ in range(RUN_MODELS)] if flags & RLE else None
    while at < len(data):
        s = data[at]
        coder.symbol(model(before), s)
        before, end = s, at + 1
        if lengths:
            while end < len(data) and data[end] == s:
                end += 1
            left, context = end - at - 1, s
            while True:
                part = min(left, RUN_SYMBOLS - 1)
                coder.symbol(lengths[context], part)
                left -= part
                context = 256 if context < 256 else 257
                if part < RUN_SYMBOLS - 1:
                    break
        at = end
    return bytes([symbols & 255]) + coder.finish()


def arithmetic_decode(data: bytes, n: int | None = None) -> bytes:
    c = Cursor(data)
    flags = c.byte()
    if not flags & NO_SIZE:
        n = read7(c)
    if n is None:
        raise ValueError("arithmetic stream of unknown size")
    if flags & STRIPE:
        return _dealt(c, n, arithmetic_decode)
    whole, symbols = n, b""
    if flags & PACK:
        symbols = c.take(c.byte())
        n = read7(c)
    if flags & CAT or not n:
        out = c.take(n)
    elif flags & EXTERNAL:
        out = bz2.decompress(c.take(len(c.data) - c.at))
    else:
        out = _plain(c, n, flags)
    return unpack(out, symbols, whole) if flags & PACK else out


def arithmetic_encode(data: bytes, flags: int = 0, streams: int = 4) -> bytes:
    if flags & STRIPE:
        inner = flags & ~STRIPE
        return bytes([STRIPE]) + uint7(len(data)) + _deal(data, streams, lambda x: arithmetic_encode(x, inner))
    head, size = b"", len(data)
    if flags & PACK:
        packed = pack(data) if data else None
        if packed is None:
            flags &= ~PACK
        else:
            head, data = packed
    if not data or flags & CAT:
        flags, body = flags & ~(ORDER1 | RLE | EXTERNAL) | CAT, data
    elif flags & EXTERNAL:
        flags, body = flags & ~(ORDER1 | RLE), bz2.compress(data)
    else:
        body = _coded_plain(data, flags)
    return bytes([flags & ~NO_SIZE]) + uint7(size) + head + body


def register() -> None:
    """Makes both methods readable and writable; done once by the CRAM source."""
    if NX16 not in DECOMPRESS:
        register_method(NX16, nx16_decode, lambda b: nx16_many(b) if len(b) > 2 * STREAM_BYTES else nx16_encode(b))
        register_method(ARITHMETIC, arithmetic_decode, lambda b: arithmetic_encode(b, ORDER1))
