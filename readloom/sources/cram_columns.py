"""Slices of CRAM files from and to Arrow columns, with whole series at a time.

Both directions give what encode_container and decode_slice of cram give record by record, byte for byte. They
take the common case: no reference, records that fit the format, series in blocks of their own. Anything else
raises Unusual, and the caller takes the records one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from readloom import schema as S
from readloom.functions.cigar import OPS, QUERY_OPS, REFERENCE_OPS
from readloom.header import Header
from readloom.sources.bam import ARROW
from readloom.sources.cram_codecs import Cursor, Encoding
from readloom.sources.records import INT_TYPES, NO_QUALITY

QUALITY_ARRAY, DETACHED, NO_SEQUENCE = 1, 2, 8
#: numpy types of the elements of arrays and of single numbers.
TYPES = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
_EMPTY = np.zeros(0, np.uint8)


class Unusual(Exception):
    """The records need the path that takes them one by one."""


def check(usual: bool) -> None:
    if not usual:
        raise Unusual


def _among(symbols: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(symbols.encode())] = True
    return out


_OPS, _QUERY, _REFERENCE, _MATCH = map(_among, (OPS, QUERY_OPS, REFERENCE_OPS, "M=X"))
_FEATURE_CODE = np.arange(256, dtype=np.uint8)
_FEATURE_CODE[list(b"M=X")] = ord("b")
#: Bytes of a variable-length integer, by its first one.
_SIZES = bytes([1] * 128 + [2] * 64 + [3] * 32 + [4] * 16 + [5] * 16)


def before(sizes: np.ndarray) -> np.ndarray:
    """Sum of the sizes before each."""
    return np.cumsum(sizes) - sizes


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 and so on of each piece."""
    return np.repeat(starts - before(sizes), sizes) + np.arange(int(sizes.sum()))


def itf8_all(x: np.ndarray) -> bytes:
    """itf8 of each, one after another."""
    u = x.astype(np.int64) & 0xFFFFFFFF
    if not len(u) or u.max() < 128:
        return u.astype(np.uint8).tobytes()
    size = 1 + sum((u >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3, 4))
    starts, out = before(size), np.empty(int(size.sum()), np.uint8)
    for k, mark in enumerate((0, 0x8000, 0xC00000, 0xE0000000), 1):
        at = np.flatnonzero(size == k)
        out[starts[at][:, None] + np.arange(k)] = (u[at] | mark).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - k :]
    at = np.flatnonzero(size == 5)
    for k, part in enumerate((u[at] >> 28 | 0xF0, u[at] >> 20, u[at] >> 12, u[at] >> 4, u[at] & 15)):
        out[starts[at] + k] = part & 255
    return out.tobytes()


def read_itf8(data: bytes, n: int) -> np.ndarray:
    """The first n integers of the data."""
    flat = np.frombuffer(data, np.uint8)
    check(len(flat) >= n)
    if n == 0 or flat[:n].max() < 128:
        return flat[:n].astype(np.int64)
    size = _SIZES[data[0]]
    sizes = np.frombuffer(_SIZES, np.uint8)
    if len(flat) >= n * size and (sizes[flat[: n * size : size]] == size).all():
        starts, each = np.arange(n) * size, np.full(n, size)
    else:
        table, at, found = data.translate(_SIZES) + b"\1", 0, []
        for _ in range(n):
            check(at < len(data))
            found.append(at)
            at += table[at]
        check(at <= len(data))
        starts = np.array(found)
        each = sizes[flat[starts]].astype(np.int64)
    out = np.zeros(n, np.int64)
    for k, mask in enumerate((0x7F, 0x3FFF, 0x1FFFFF, 0xFFFFFFF), 1):
        at = np.flatnonzero(each == k)
        if len(at):
            value = np.zeros(len(at), np.int64)
            for j in range(k):
                value = value << 8 | flat[starts[at] + j]
            out[at] = value & mask
    at = np.flatnonzero(each == 5)
    if len(at):
        a, b, c, d, e = (flat[starts[at] + j].astype(np.int64) for j in range(5))
        value = (a & 15) << 28 | b << 20 | c << 12 | d << 4 | e & 15
        out[at] = np.where(value >> 31, value - (1 << 32), value)
    return out


# --- encoding ------------------------------------------------------------------------------


@dataclass
class Gathered:
    """The data of a slice's series and tags, and what its headers say."""

    series: dict[str, bytes]
    lists: dict[tuple[bytes, ...], int] = field(default_factory=dict)
    tag_data: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    extent: dict[int, tuple[int, int]] = field(default_factory=dict)
    slice_ref: int = -2
    records: int = 0
    bases: int = 0
    unplaced: bool = False


def _numbers(column: pa.Array) -> np.ndarray:
    check(not column.null_count)
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths; nulls are empty."""
    check(pa.types.is_string(column.type) or pa.types.is_binary(column.type))
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if not len(column):
        return _EMPTY, np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else _EMPTY
    check(pa.types.is_binary(column.type) or not len(flat) or flat.max() < 128)
    return flat, np.diff(ends)


def _ended(flat: np.ndarray, sizes: np.ndarray) -> bytes:
    """The texts, each with a zero byte behind it."""
    out = np.zeros(len(flat) + len(sizes), np.uint8)
    text = np.ones(len(out), bool)
    text[np.cumsum(sizes + 1) - 1] = False
    out[text] = flat
    return out.tobytes()


def _lists(column: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements and lengths of the lists at the places, which rise."""
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)[at]
    check(not column.null_count or bool(column.is_valid().to_numpy(zero_copy_only=False)[at].all()))
    values = column.values.slice(ends[0], ends[-1] - ends[0])
    check(not values.null_count)
    flat = values.to_numpy(zero_copy_only=False)
    return (flat if sizes.sum() == len(flat) else flat[ranges(ends[:-1][at] - ends[0], sizes)]), sizes


def gather(b: pa.RecordBatch, keys: dict[str, int], groups: dict[str, int]) -> Gathered:
    """The series of the rows of one slice, by their keys."""
    n = b.num_rows
    out = {k: b"" for k in keys}
    col = {name: b.column(name) for name in b.schema.names}
    flag, ref, pos = (_numbers(col[k]) for k in ("flag", "ref_id", "pos"))
    mapped = flag & S.UNMAPPED == 0
    seq, seq_n = _texts(col["seq"])

    # CIGARs of the mapped records.
    check(not col["cigar"].null_count)
    counts = np.diff(col["cigar"].offsets.to_numpy())
    op_texts, lengths = col["cigar"].flatten().flatten()
    op, widths = _texts(op_texts)
    check(bool((widths == 1).all()) and bool(_OPS[op].all()))
    length = _numbers(lengths)
    check(not len(length) or length.min() >= 0)
    rec = np.repeat(np.arange(n), counts)
    kept = mapped[rec]
    op, length, rec = op[kept], length[kept], rec[kept]
    q_len = np.where(_QUERY[op], length, 0)
    query = np.bincount(rec, q_len, n).astype(np.int64)
    check(bool(((seq_n == query) | (seq_n == 0) | ~mapped).all()))
    size = np.where(seq_n > 0, seq_n, query)  # query is 0 where not mapped

    of_mapped = np.repeat(mapped, seq_n)
    out["BA"] = seq[~of_mapped].tobytes()
    has = seq_n[rec] > 0
    bases = np.full(int(q_len.sum()), ord("N"), np.uint8)
    bases[np.repeat(has, q_len)] = seq[of_mapped]
    code = _FEATURE_CODE[op]
    feature = has | (code != ord("b"))
    by_base = np.repeat(np.where(feature, code, 0), q_len)
    at = before(q_len)
    starts = before(np.bincount(rec, minlength=n))
    at = 1 + at - (at[np.minimum(starts[rec], max(len(at) - 1, 0))] if len(at) else 0)
    code, at, rec_f, length_f = code[feature], at[feature], rec[feature], length[feature]
    step = np.diff(at, prepend=0)
    first = np.diff(rec_f, prepend=-1) != 0
    out["FN"] = itf8_all(np.bincount(rec_f, minlength=n)[mapped])
    out["FC"] = code.tobytes()
    out["FP"] = itf8_all(np.where(first, at, step))
    for mark, key in (("b", "BB"), ("I", "IN"), ("S", "SC")):
        out[key] = bases[by_base == ord(mark)].tobytes()
        out[f"{key}-length"] = itf8_all(length_f[code == ord(mark)])
    for mark, key in (("D", "DL"), ("N", "RS"), ("P", "PD"), ("H", "HC")):
        out[key] = itf8_all(length_f[code == ord(mark)])
    out["MQ"] = itf8_all(_numbers(col["mapq"])[mapped])

    # Qualities.
    qual, qual_n = _texts(col["qual"])
    rated = col["qual"].is_valid().to_numpy(zero_copy_only=False)
    check(bool(((qual_n == size) | ~rated).all()))
    quality = np.full(int(size.sum()), NO_QUALITY, np.uint8)
    quality[np.repeat(rated, size)] = qual
    out["QS"] = quality.tobytes()

    out["RN"] = _ended(*_texts(col["qname"]))
    out["BF"], out["RL"], out["AP"], out["RI"] = map(itf8_all, (flag, size, pos + 1, ref))
    out["CF"] = itf8_all(DETACHED | np.where(size > 0, QUALITY_ARRAY, 0) | np.where((seq_n > 0) | (size == 0), 0, NO_SEQUENCE))
    out["MF"] = itf8_all(np.where(flag & S.MATE_REVERSE, 1, 0) | np.where(flag & S.MATE_UNMAPPED, 2, 0))
    out["NS"], out["NP"], out["TS"] = itf8_all(_numbers(col["next_ref_id"])), itf8_all(_numbers(col["next_pos"]) + 1), itf8_all(_numbers(col["tlen"]))

    got = Gathered(out, records=n, bases=int(size.sum()), unplaced=bool((ref < 0).any()))
    spans = np.bincount(rec, np.where(_REFERENCE[op], length, 0), n).astype(np.int64)
    end = np.maximum(pos + 1, pos + spans)
    order = np.argsort(ref, kind="stable")
    edges = np.flatnonzero(np.diff(ref[order], prepend=np.int64(-(2**40))))
    for r, low, high in zip(ref[order][edges].tolist(), np.minimum.reduceat(pos[order], edges).tolist(), np.maximum.reduceat(end[order], edges).tolist(), strict=True):
        if r >= 0:
            got.extent[r] = low, high
    if len(edges) == 1:
        got.slice_ref = int(ref[0])
    _gather_tags(col["tags"], n, groups, got)
    return got


def _gather_tags(column: pa.MapArray, n: int, groups: dict[str, int], got: Gathered) -> None:
    check(not column.null_count)
    ends = column.offsets.to_numpy().astype(np.int64)
    total = int(ends[-1] - ends[0])
    rec = np.repeat(np.arange(n), np.diff(ends))
    names, items = column.keys.slice(ends[0], total).dictionary_encode(), column.items.slice(ends[0], total)
    check(not items.null_count and not names.null_count)
    words = names.dictionary.to_pylist()
    check(all(len(w) == 2 and w.isascii() for w in words))
    name = names.indices.to_numpy().astype(np.int64)
    fields = dict(zip([f.name for f in items.type], items.flatten(), strict=True))
    kinds = fields["t"].dictionary_encode()
    check(not kinds.null_count)
    letters = kinds.dictionary.to_pylist()
    check(all(t in ("A", "i", "f", "Z", "H", "B") for t in letters))
    kind = np.array([ord(t) for t in letters], np.int64)[kinds.indices.to_numpy()] if total else np.zeros(0, np.int64)
    group = np.full(n, -1, np.int64)
    kept = np.ones(total, bool)
    if groups and "RG" in words:
        at = np.flatnonzero(name == words.index("RG"))
        number = np.array([groups.get(s, -1) for s in fields["s"].take(pa.array(at)).to_pylist()], np.int64)
        group[rec[at]] = number
        kept[at[number >= 0]] = False
    got.series["RG"] = itf8_all(group)

    values = fields["i"]
    whole = kind == ord("i")
    if whole.any():
        check(not values.null_count or bool(values.is_valid().to_numpy(zero_copy_only=False)[whole].all()))
        x = (values.fill_null(0) if values.null_count else values).to_numpy(zero_copy_only=False)
        check(bool(((x >= INT_TYPES[-1][1]) & (x <= INT_TYPES[-2][2]))[whole].all()))
        for code, low, high in reversed(INT_TYPES):
            kind[whole & (x >= low) & (x <= high)] = ord(code)
    rank = np.argsort(np.argsort(words)) if words else np.zeros(0, np.int64)
    order = np.lexsort((rank[name], rec))
    check(not ((np.diff(rec[order]) == 0) & (np.diff(name[order]) == 0)).any())
    order = order[kept[order]]
    prefix = np.array([ord(w[0]) << 16 | ord(w[1]) << 8 for w in words], np.int64)
    code, rec = (prefix[name[order]] | kind[order] if total else name), rec[order]

    # Which records have the same list of tags.
    counts = np.bincount(rec, minlength=n)
    starts, same = before(counts), np.zeros(n, np.int64)
    for j in range(int(counts.max(initial=0))):
        here = np.flatnonzero(counts > j)
        key = same << 24
        key[here] |= code[starts[here] + j]
        same = np.unique(key, return_inverse=True)[1].reshape(-1)
    _, firsts, same = np.unique(same, return_index=True, return_inverse=True)
    turn = np.argsort(firsts)
    place = np.empty(len(turn), np.int64)
    place[turn] = np.arange(len(turn))
    for k, i in enumerate(firsts[turn].tolist()):
        got.lists[tuple(int(c).to_bytes(3, "big") for c in code[starts[i] : starts[i] + counts[i]])] = k
    got.series["TL"] = itf8_all(place[same.reshape(-1)])

    found, firsts = np.unique(code, return_index=True)
    for c in found[np.argsort(firsts)].tolist():
        at = order[code == c]
        sizes, body = _tag_bodies(chr(c & 255), fields, at)
        got.tag_data[c] = itf8_all(sizes), body


def _tag_bodies(letter: str, fields: dict[str, pa.Array], at: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes of the values at the places, which rise, of one tag and type."""
    if letter == "B":
        coded = fields["et"].take(pa.array(at)).dictionary_encode()
        check(not coded.null_count)
        letters = coded.dictionary.to_pylist()
        check(all(t in TYPES for t in letters))
        which = coded.indices.to_numpy()
        parts = []
        for k, t in enumerate(letters):
            mine = np.flatnonzero(which == k)
            flat, sizes = _lists(fields["af" if t == "f" else "ai"], at[mine])
            if t != "f" and len(flat):
                kind = np.iinfo(TYPES[t])
                check(flat.min() >= kind.min and flat.max() <= kind.max)
            parts.append((t, mine, flat.astype(TYPES[t]), sizes))
        total = np.zeros(len(at), np.int64)
        for t, mine, _, sizes in parts:
            total[mine] = 5 + sizes * np.dtype(TYPES[t]).itemsize
        starts, out = before(total), np.empty(int(total.sum()), np.uint8)
        for t, mine, flat, sizes in parts:
            head = starts[mine][:, None] + np.arange(5)
            out[head[:, 0]] = ord(t)
            out[head[:, 1:]] = sizes.astype("<u4").view(np.uint8).reshape(-1, 4)
            if len(parts) == 1:
                rest = np.ones(len(out), bool)
                rest[head] = False
                out[rest] = flat.view(np.uint8)
            else:
                out[ranges(starts[mine] + 5, total[mine] - 5)] = flat.view(np.uint8)
        return total, out.tobytes()
    if letter in "AZH":
        texts = fields["s"].take(pa.array(at))
        check(not texts.null_count)
        flat, sizes = _texts(texts)
        return (sizes, flat.tobytes()) if letter == "A" else (sizes + 1, _ended(flat, sizes))
    values = fields["f" if letter == "f" else "i"].take(pa.array(at))
    check(not values.null_count)
    kind = np.dtype(TYPES[letter])
    return np.full(len(at), kind.itemsize), values.to_numpy(zero_copy_only=False).astype(kind).tobytes()


# --- decoding ------------------------------------------------------------------------------


def _strings(flat: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None, kind: pa.DataType = ARROW.field("qname").type) -> pa.Array:
    check(pa.types.is_binary(kind) or not len(flat) or flat.max() < 128)
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    mask = None if valid is None else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(kind, len(sizes), [mask, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _spread(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements, lengths and which are there, of n entries from (places, lengths, elements)."""
    sizes, valid = np.zeros(n, np.int64), np.zeros(n, bool)
    for at, each, _ in parts:
        sizes[at], valid[at] = each, True
    if len(parts) == 1:
        return parts[0][2].astype(kind), sizes, valid
    out, starts = np.empty(int(sizes.sum()), kind), before(sizes)
    for at, each, flat in parts:
        out[ranges(starts[at], each)] = flat
    return out, sizes, valid


class _Series:
    """Blocks of a slice by series; each series has blocks of its own."""

    def __init__(self, series: dict[str, Encoding], tag_series: dict[int, Encoding], external: dict[int, bytes]):
        self.external, self.series = external, series
        self.owned: set[int] = set()
        for e in [*series.values(), *tag_series.values()]:
            self._own(e)

    def _own(self, e: Encoding) -> None:
        if e.kind == 4:
            self._own(e.length)
            self._own(e.bytes_)
        else:
            check(e.kind in (1, 5) and e.block not in self.owned)
            self.owned.add(e.block)

    def block(self, e: Encoding, kind: int = 1) -> bytes:
        check(e.kind == kind and e.block in self.external)
        return self.external[e.block]

    def numbers(self, key: str, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.int64)
        check(key in self.series)
        return read_itf8(self.block(self.series[key]), n)

    def many(self, e: Encoding | None, n: int) -> np.ndarray:
        if not n:
            return _EMPTY
        check(e is not None)
        data = np.frombuffer(self.block(e), np.uint8)
        check(len(data) >= n)
        return data[:n]

    def arrays(self, e: Encoding | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and lengths of n arrays."""
        if not n:
            return _EMPTY, np.zeros(0, np.int64)
        check(e is not None and e.kind == 4)
        sizes = read_itf8(self.block(e.length), n)
        check(sizes.min() >= 0)
        return self.many(e.bytes_, int(sizes.sum())), sizes


def decode(header: Header, comp, external: dict[int, bytes], slice_header: Cursor, wanted=None) -> pa.RecordBatch:
    """The rows of a slice in the reads schema; file_ord, rec_no and voffset are null."""
    c = slice_header
    ref_id, start, _, n = (c.itf8() for _ in range(4))
    c.ltf8()
    c.itf8()
    for _ in range(c.itf8()):
        c.itf8()
    check(c.itf8() < 0 and comp.names and n > 0 and "RN" in comp.series)
    source = _Series(comp.series, comp.tag_series, external)
    flag, extra = source.numbers("BF", n), source.numbers("CF", n)
    own = source.numbers("RI", n) if ref_id == -2 else np.full(n, ref_id, np.int64)
    size, place, group = source.numbers("RL", n), source.numbers("AP", n), source.numbers("RG", n)
    check(size.min() >= 0)
    check(bool((extra & DETACHED).all()) and not (extra & NO_SEQUENCE).any() and bool(((extra & QUALITY_ARRAY > 0) | (size == 0)).all()))
    pos = (start + np.cumsum(place) if comp.delta else place) - 1
    next_ref, next_pos, tlen = source.numbers("NS", n), source.numbers("NP", n) - 1, source.numbers("TS", n)
    mapped = flag & S.UNMAPPED == 0
    some = int(mapped.sum())

    names = comp.series["RN"]
    text = np.frombuffer(source.block(names, 5), np.uint8)
    stops = np.flatnonzero(text == names.stop)[:n]
    check(len(stops) == n)
    text = text[: stops[-1] + 1]
    inner = np.ones(len(text), bool)
    inner[stops] = False
    qname = _strings(text[inner], np.diff(stops, prepend=-1) - 1)

    # Features: what they add to the read and to the reference.
    counts = source.numbers("FN", some)
    check(not some or counts.min() >= 0)
    features = int(counts.sum())
    code = source.many(comp.series.get("FC"), features)
    step = source.numbers("FP", features)
    check(not features or bool(_among("bSIDNPH")[code].all()))
    length, q_len, data = np.zeros(features, np.int64), np.zeros(features, np.int64), {}
    for mark, key in (("b", "BB"), ("I", "IN"), ("S", "SC")):
        at = code == ord(mark)
        data[mark], sizes = source.arrays(comp.series.get(key), int(at.sum()))
        length[at] = q_len[at] = sizes
    for mark, key in (("D", "DL"), ("N", "RS"), ("P", "PD"), ("H", "HC")):
        at = code == ord(mark)
        length[at] = source.numbers(key, int(at.sum()))
    rec = np.repeat(np.arange(some), counts)
    check(bool((np.bincount(rec, q_len, some).astype(np.int64) == size[mapped]).all()))
    if features:  # no gaps, which the reference would fill
        firsts = before(counts)[rec]
        begins = before(q_len)
        sums = np.cumsum(step)
        check(bool((sums - (sums - step)[firsts] == 1 + begins - begins[firsts]).all()))
    by_base = np.repeat(code, q_len)
    bases = np.empty(len(by_base), np.uint8)
    for mark, flat in data.items():
        bases[by_base == ord(mark)] = flat
    of_mapped = np.repeat(mapped, size)
    seq = np.empty(len(of_mapped), np.uint8)
    seq[of_mapped] = bases
    seq[~of_mapped] = source.many(comp.series.get("BA"), int(size[~mapped].sum()))
    mapq = np.zeros(n, np.int64)
    mapq[mapped] = source.numbers("MQ", some)
    check(not n or (mapq.min() >= -(2**15) and mapq.max() < 2**15))

    op = np.where(code == ord("b"), np.uint8(ord("M")), code)
    real = length > 0
    op, op_rec, op_len = op[real], np.flatnonzero(mapped)[rec[real]], length[real]
    heads = np.flatnonzero((np.diff(op_rec, prepend=-1) != 0) | (np.diff(op.astype(np.int64), prepend=0) != 0))
    op_len = np.add.reduceat(op_len, heads) if len(heads) else op_len
    kind = ARROW.field("cigar").type
    ops = pa.StructArray.from_arrays([_strings(op[heads], np.ones(len(heads), np.int64)), pa.array(op_len.astype(np.int32))], fields=list(kind.value_type))
    cigar = pa.ListArray.from_arrays(_ends(np.bincount(op_rec[heads], minlength=n)), ops, type=kind)

    quality = source.many(comp.series.get("QS"), int(size.sum()))
    rated = np.zeros(n, bool)
    full = np.flatnonzero(size)
    if len(full):
        rated[full] = np.minimum.reduceat(quality, before(size)[full]) != NO_QUALITY
    qual = _strings(quality[np.repeat(rated, size)], np.where(rated, size, 0), rated, pa.binary())

    def refname(ids: np.ndarray) -> pa.Array:
        found, each = np.unique(ids, return_inverse=True)
        return pa.array([header.reference_name(i) for i in found.tolist()], pa.string()).take(pa.array(each.reshape(-1)))

    made = {
        "qname": qname,
        "flag": flag,
        "ref_id": own,
        "rname": refname(own),
        "pos": pos,
        "mapq": mapq,
        "cigar": cigar,
        "next_ref_id": next_ref,
        "next_rname": refname(next_ref),
        "next_pos": next_pos,
        "tlen": tlen,
        "seq": _strings(seq, size),
        "qual": qual,
        "tags": _decode_tags(header, comp, source, source.numbers("TL", n), group, wanted),
    }
    arrays = []
    for f in ARROW:
        x = made.get(f.name)
        arrays.append(pa.nulls(n, f.type) if x is None else pa.array(x).cast(f.type) if isinstance(x, np.ndarray) else x)
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def _decode_tags(header: Header, comp, source: _Series, which: np.ndarray, group: np.ndarray, wanted) -> pa.Array:
    n = len(which)
    check(which.min() >= 0 and which.max() < len(comp.tags))
    lists = [[x for x in tags if wanted is None or wanted(x[0])] for tags in comp.tags]
    grouped = (group >= 0) & (group < len(header.read_groups)) if wanted is None or wanted("RG") else np.zeros(n, bool)
    check(all(len({k for k, _ in tags}) == len(tags) for tags in lists))
    check(not (grouped & np.array([any(k == "RG" for k, _ in tags) for tags in lists])[which]).any())
    counts = np.array([len(x) for x in lists])[which] + grouped
    starts, total = before(counts), int(counts.sum())
    places: dict[tuple[str, str], list[np.ndarray]] = {}
    for k in np.unique(which).tolist():
        at = starts[which == k]
        for j, tag in enumerate(lists[k]):
            places.setdefault(tag, []).append(at + j)
    keys, letters = np.zeros((total, 2), np.uint8), np.zeros(total, np.uint8)
    numbers, has_number = np.zeros(total, np.int64), np.zeros(total, bool)
    floats, has_float = np.zeros(total, np.float32), np.zeros(total, bool)
    texts, elements, whole, real = [], np.zeros(total, np.uint8), [], []
    for (key, letter), found in places.items():
        at = np.sort(np.concatenate(found))
        keys[at] = list(key.encode("latin-1"))
        check(key.isascii())
        letters[at] = ord(letter) if letter in "AfZHB" else ord("i")
        code = ord(key[0]) << 16 | ord(key[1]) << 8 | ord(letter)
        check(code in comp.tag_series)
        flat, sizes = source.arrays(comp.tag_series[code], len(at))
        if letter == "B":
            _decode_arrays(flat, sizes, at, elements, whole, real)
        elif letter in "ZH":
            check(sizes.min() >= 1)
            ends = np.flatnonzero(flat == 0)
            check(len(ends) == len(at) and bool((ends == np.cumsum(sizes) - 1).all()))
            texts.append((at, sizes - 1, flat[flat != 0]))
        elif letter == "A":
            check(bool((sizes == 1).all()))
            texts.append((at, sizes, flat))
        else:
            check(letter in TYPES)
            kind = np.dtype(TYPES[letter])
            check(bool((sizes == kind.itemsize).all()))
            into, there = (floats, has_float) if letter == "f" else (numbers, has_number)
            into[at], there[at] = np.frombuffer(flat.tobytes(), kind), True
    if grouped.any():
        at = (starts + counts - 1)[grouped]
        keys[at], letters[at] = list(b"RG"), ord("Z")
        ids = [header.read_groups[g].key for g in group[grouped].tolist()]
        flat, sizes = _texts(pa.array(ids, pa.string()))
        texts.append((at, sizes, flat))
    kind = ARROW.field("tags").type
    ai, ai_n, has_ai = _spread(whole, total, np.int64)
    af, af_n, has_af = _spread(real, total, np.float32)
    text, text_n, has_text = _spread(texts, total, np.uint8)
    one = np.ones(total, np.int64)
    there = elements > 0
    made = [
        _strings(letters, one),
        pa.array(numbers, mask=~has_number),
        pa.array(floats, mask=~has_float),
        _strings(text, text_n, has_text),
        _strings(elements[there], there.astype(np.int64), there),
        pa.ListArray.from_arrays(_ends(ai_n), pa.array(ai), mask=pa.array(~has_ai)),
        pa.ListArray.from_arrays(_ends(af_n), pa.array(af), mask=pa.array(~has_af)),
    ]
    items = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(made, kind.item_type, strict=True)], fields=list(kind.item_type))
    return pa.MapArray.from_arrays(_ends(counts), _strings(keys.reshape(-1), 2 * one), items, kind)


def _decode_arrays(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray, elements: np.ndarray, whole: list, real: list) -> None:
    """Values of type B: an element type, a count and the elements."""
    check(sizes.min() >= 5)
    starts = before(sizes)
    kinds = flat[starts]
    elements[at] = kinds
    heads = starts[:, None] + np.arange(1, 5)
    counts = np.ascontiguousarray(flat[heads]).view("<u4").reshape(-1).astype(np.int64)
    for k in np.unique(kinds).tolist():
        check(chr(k) in TYPES)
        kind, mine = np.dtype(TYPES[chr(k)]), kinds == k
        check(bool((sizes[mine] == 5 + counts[mine] * kind.itemsize).all()))
        inner = np.repeat(mine, sizes)
        head = starts[mine]
        inner[heads[mine]] = False
        inner[head] = False
        values = np.frombuffer(flat[inner].tobytes(), kind)
        (real if kind.kind == "f" else whole).append((at[mine], counts[mine], values))
