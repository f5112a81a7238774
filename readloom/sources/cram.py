"""CRAM 3.0 as a Spark data source.

Reading: a partition is a container; the driver walks the container headers only, and filters on ref_id
and pos drop containers (by the header, or by slice with a CRAI beside the file). Options: reference (a
FASTA, by default from $READLOOM_CRAM_REFERENCE), keep_tags, drop_tags, columns, slice (container:slice
offsets).

Writing: tasks encode containers of at most ``slice_records`` records or ``slice_bases`` bases, each with
one slice; the commit numbers them, puts the header before and the end marker behind, and with the option
crai writes the index. With a reference, matching bases are left out; without one they are stored.

As the format has it, '=' and 'X' come back as 'M', and tags RG of groups in the header as their number.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from readloom import schema as S
from readloom.functions.cigar import QUERY_OPS, REFERENCE_OPS
from readloom.header import Header, parse_header
from readloom.sources import cram_codecs as K
from readloom.sources import cram_codecs31 as M31
from readloom.sources import cram_columns, parts
from readloom.sources.bam import BATCH_ROWS, batch, expand, tag_filter
from readloom.sources.columns import rows_of_batch
from readloom.sources.cram_codecs import Bits, Cursor, Encoding, itf8, ltf8
from readloom.sources.fasta import Fasta
from readloom.sources.records import NO_QUALITY, decode_tags, encode_tag, tag

REFERENCE_VARIABLE = "READLOOM_CRAM_REFERENCE"
SLICE_RECORDS, SLICE_BASES = 10_000, 20_000_000
#: The container that ends a file.
EOF = bytes.fromhex("0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b")
QUALITY_ARRAY, DETACHED, MATE_DOWNSTREAM, NO_SEQUENCE = 1, 2, 4, 8
FILE_HEADER, COMPRESSION_HEADER, SLICE_HEADER, EXTERNAL, CORE = 0, 1, 2, 4, 5
#: Base that each code stands for, by reference base, where the header sets no other.
SUBSTITUTIONS = {"A": "CGTN", "C": "AGTN", "G": "ACTN", "T": "ACGN", "N": "ACGT"}


# --- containers and blocks -----------------------------------------------------------------


@dataclass
class Container:
    offset: int
    length: int
    ref_id: int
    start: int
    span: int
    records: int
    counter: int
    blocks: int
    landmarks: list[int]
    body: int  # offset of the first block

    @property
    def is_end(self) -> bool:
        return self.records == 0 and self.ref_id == -1 and self.start == 0x454F46


@dataclass
class Block:
    kind: int
    content_id: int
    data: bytes


def parse_container(data: bytes, offset: int) -> Container:
    c = Cursor(data)
    fields = [c.int32(), *(c.itf8() for _ in range(4)), c.ltf8()]
    c.ltf8()  # bases
    blocks = c.itf8()
    landmarks = [c.itf8() for _ in range(c.itf8())]
    if zlib.crc32(data[: c.at]) != struct.unpack("<I", c.take(4))[0]:
        raise ValueError("CRAM container header is damaged")
    return Container(offset, *fields, blocks, landmarks, offset + c.at)


def format_container(length: int, ref_id: int, start: int, span: int, records: int, counter: int, bases: int, blocks: int, landmarks: list[int]) -> bytes:
    head = struct.pack("<i", length) + itf8(ref_id) + itf8(start) + itf8(span) + itf8(records) + ltf8(counter) + ltf8(bases) + itf8(blocks)
    head += itf8(len(landmarks)) + b"".join(map(itf8, landmarks))
    return head + struct.pack("<I", zlib.crc32(head))


def parse_block(c: Cursor) -> Block:
    at = c.at
    method, kind = c.byte(), c.byte()
    content_id, packed, size = c.itf8(), c.itf8(), c.itf8()
    data = c.take(packed)
    if zlib.crc32(c.data[at : c.at]) != struct.unpack("<I", c.take(4))[0]:
        raise ValueError("CRAM block is damaged")
    return Block(kind, content_id, K.decompress(method, data, size))


def format_block(kind: int, content_id: int, data: bytes, methods: tuple[int, ...] = (K.RAW,)) -> bytes:
    """The block in the smallest of the methods' forms; RAW if none is smaller."""
    method, packed = K.RAW, data
    for m in methods if len(data) > 16 else ():
        other = K.COMPRESS[m](data)
        if len(other) < len(packed):
            method, packed = m, other
    out = bytes([method, kind]) + itf8(content_id) + itf8(len(packed)) + itf8(len(data)) + packed
    return out + struct.pack("<I", zlib.crc32(out))


def containers(path: str, first: bool = False) -> tuple[Header, list[Container]]:
    """The header and all containers with records (first: the header only); reads their headers only."""
    size, out = os.path.getsize(path), []
    with open(path, "rb") as f:
        head = f.read(26)
        if head[:4] != b"CRAM" or head[4] != 3:
            raise ValueError(f"not a CRAM 3 file: {path}")
        at, header = 26, None
        while at < size:
            f.seek(at)
            c = parse_container(f.read(1 << 16), at)
            if header is None:
                f.seek(c.body)
                text = Cursor(parse_block(Cursor(f.read(c.length))).data)
                header = parse_header(text.take(text.int32()).split(b"\0")[0].decode())
                if first:
                    break
            elif c.records:
                out.append(c)
            at = c.body + c.length
    if header is None:
        raise ValueError(f"CRAM file without a header: {path}")
    return header, out


def has_eof(path: str) -> bool:
    with open(path, "rb") as f:
        f.seek(max(0, os.path.getsize(path) - len(EOF)))
        tail = bytearray(f.read())
    return len(tail) == len(EOF) and bytes([*tail[:8], tail[8] & 15, *tail[9:]]) == EOF


# --- decoding ------------------------------------------------------------------------------


@dataclass
class Compression:
    names: bool = True
    delta: bool = True
    reference: bool = True
    matrix: dict[str, str] = field(default_factory=dict)
    tags: list[list[tuple[str, str]]] = field(default_factory=list)
    series: dict[str, Encoding] = field(default_factory=dict)
    tag_series: dict[int, Encoding] = field(default_factory=dict)


def parse_compression(data: bytes) -> Compression:
    c, out = Cursor(data), Compression()
    out.matrix = dict(SUBSTITUTIONS)
    c.itf8()
    for _ in range(c.itf8()):
        key = c.take(2)
        if key == b"SM":
            codes = c.take(5)
            if any(codes):
                for base, byte in zip("ACGTN", codes, strict=True):
                    places = {byte >> (6 - 2 * k) & 3: other for k, other in enumerate(SUBSTITUTIONS[base])}
                    out.matrix[base] = "".join(places.get(i, "N") for i in range(4))
        elif key == b"TD":
            lists = c.take(c.itf8())
            out.tags = [[(x[i : i + 2].decode(), chr(x[i + 2])) for i in range(0, len(x), 3)] for x in lists.split(b"\0")[:-1]]
        else:
            value = bool(c.byte())
            if key == b"RN":
                out.names = value
            elif key == b"AP":
                out.delta = value
            elif key == b"RR":
                out.reference = value
    c.itf8()
    for _ in range(c.itf8()):
        key = c.take(2).decode()
        out.series[key] = Encoding(c)
    c.itf8()
    for _ in range(c.itf8()):
        key = c.itf8()
        out.tag_series[key] = Encoding(c)
    return out


class Bases:
    """Reference bases of a slice: embedded, or windows of a FASTA."""

    def __init__(self, fasta: Fasta | None, header: Header):
        self.fasta, self.header = fasta, header
        self.ref_id, self.start, self.bases = -1, 0, ""

    def embed(self, ref_id: int, start: int, bases: str) -> None:
        self.ref_id, self.start, self.bases = ref_id, start, bases.upper()

    def get(self, ref_id: int, beg: int, end: int) -> str:
        """Bases [beg, end), N where there are none."""
        if not (ref_id == self.ref_id and self.start <= beg and end <= self.start + len(self.bases)):
            if self.fasta is None:
                return "N" * (end - beg)
            self.ref_id, self.start = ref_id, max(beg, 0)
            self.bases = self.fasta.fetch(self.header.reference_name(ref_id), beg, max(end, beg + (1 << 20)))
        part = self.bases[max(beg - self.start, 0) : max(end - self.start, 0)]
        return part + "N" * (end - beg - len(part))


def _append(cigar: list[list], op: str, n: int) -> None:
    if n > 0:
        if cigar and cigar[-1][0] == op:
            cigar[-1][1] += n
        else:
            cigar.append([op, n])


#: Features: the series of each code's value and how it is read.
_FEATURES = {"X": ("BS", "byte"), "i": ("BA", "byte"), "Q": ("QS", "byte"), "I": ("IN", "array"), "b": ("BB", "array"), "q": ("QQ", "array"), "S": ("SC", "array")}
_FEATURES |= {"D": ("DL", "number"), "N": ("RS", "number"), "P": ("PD", "number"), "H": ("HC", "number")}


def decode_slice(header: Header, comp: Compression, blocks: list[Block], slice_header: Cursor, bases: Bases, wanted=None, check: bool = True) -> list[dict]:
    """Rows of one slice. Its blocks follow its header."""
    c = slice_header
    ref_id, start, span, n = (c.itf8() for _ in range(4))
    c.ltf8()
    c.itf8()
    for _ in range(c.itf8()):
        c.itf8()
    embedded = c.itf8()
    md5 = c.take(16)
    core = Bits(next((b.data for b in blocks if b.kind == CORE), b""))
    ext = {b.content_id: Cursor(b.data) for b in blocks if b.kind == EXTERNAL}
    if embedded >= 0:
        bases.embed(ref_id, start - 1, ext[embedded].data.decode())
    elif check and comp.reference and ref_id >= 0 and any(md5) and bases.fasta is not None:
        if hashlib.md5(bases.get(ref_id, start - 1, start - 1 + span).encode()).digest() != md5:
            raise ValueError(f"the reference differs from that of the CRAM at {header.reference_name(ref_id)}:{start}+{span}")
    series = comp.series

    def number(key: str, default: int = 0) -> int:
        return series[key].number(core, ext) if key in series else default

    rows, downstream, previous = [], [], start
    for _ in range(n):
        flag, extra = number("BF"), number("CF")
        own = number("RI", ref_id) if ref_id == -2 else ref_id
        length = number("RL")
        place = number("AP")
        previous = place = previous + place if comp.delta else place
        pos = place - 1
        group = number("RG", -1)
        name = series["RN"].array(core, ext).decode("latin-1") if comp.names and "RN" in series else ""
        mate, distance = (-1, -1, 0), -1
        if extra & DETACHED:
            number("MF")
            if not comp.names and "RN" in series:
                name = series["RN"].array(core, ext).decode("latin-1")
            mate = (number("NS", -1), number("NP") - 1, number("TS"))
        elif extra & MATE_DOWNSTREAM:
            distance = number("NF")
        listed = comp.tags[t] if 0 <= (t := number("TL")) < len(comp.tags) else []
        tags = {}
        for key, kind in listed:
            value = comp.tag_series[ord(key[0]) << 16 | ord(key[1]) << 8 | ord(kind)].array(core, ext)
            if wanted is None or wanted(key):
                tags |= decode_tags(key.encode() + kind.encode() + value, 0, 3 + len(value))
        if 0 <= group < len(header.read_groups) and (wanted is None or wanted("RG")):
            tags["RG"] = tag("Z", s=header.read_groups[group].key)
        quals, cigar, mapq = None, [], 0
        if flag & S.UNMAPPED:
            seq = series["BA"].many(length, core, ext).decode("latin-1") if "BA" in series and not extra & NO_SEQUENCE else ""
            if extra & QUALITY_ARRAY:
                quals = bytearray(series["QS"].many(length, core, ext))
        else:
            features, at = [], 0
            for _ in range(number("FN")):
                code = chr(series["FC"].byte(core, ext))
                at += number("FP")
                if code == "B":
                    features.append((code, at, (series["BA"].byte(core, ext), series["QS"].byte(core, ext))))
                    continue
                if code not in _FEATURES:
                    raise ValueError(f"unknown CRAM feature {code!r}")
                key, how = _FEATURES[code]
                features.append((code, at, getattr(series[key], how)(core, ext)))
            mapq = number("MQ")
            if extra & QUALITY_ARRAY:
                quals = bytearray(series["QS"].many(length, core, ext))
            else:
                quals = bytearray([NO_QUALITY]) * length
            seq, cigar = _rebuild(features, length, own, pos, comp, bases, quals if not extra & QUALITY_ARRAY else None, bool(extra & NO_SEQUENCE))
        if quals is not None and (not seq or all(q == NO_QUALITY for q in quals)):
            quals = None
        rows.append(
            {
                "qname": name,
                "flag": flag,
                "ref_id": own,
                "rname": header.reference_name(own),
                "pos": pos,
                "mapq": mapq,
                "cigar": [{"op": op, "len": k} for op, k in cigar],
                "next_ref_id": mate[0],
                "next_pos": mate[1],
                "tlen": mate[2],
                "seq": seq,
                "qual": None if quals is None else bytes(quals),
                "tags": tags,
            }
        )
        downstream.append(distance)
    _join_mates(rows, downstream)
    for r in rows:
        r["next_rname"] = header.reference_name(r["next_ref_id"])
    return rows


def _rebuild(features, length: int, ref_id: int, pos: int, comp: Compression, bases: Bases, quals: bytearray | None, omitted: bool) -> tuple[str, list[list]]:
    """Sequence and CIGAR from the features; single qualities go into quals."""
    seq, cigar, read, ref = [], [], 1, pos

    def match(n: int) -> None:
        nonlocal read, ref
        if n > 0:
            seq.append(bases.get(ref_id, ref, ref + n) if not omitted else "")
            _append(cigar, "M", n)
            read, ref = read + n, ref + n

    for code, at, value in features:
        if code in "Qq":
            for k, q in enumerate(value if code == "q" else (value,)):
                if quals is not None and 0 <= at - 1 + k < len(quals):
                    quals[at - 1 + k] = q
            continue
        match(at - read)
        if code in "BXb":
            if code == "X":
                base = bases.get(ref_id, ref, ref + 1)
                text = comp.matrix.get(base, comp.matrix["N"])[value & 3]
            else:
                text = value.decode("latin-1") if code == "b" else chr(value[0])
            if code == "B" and quals is not None and at - 1 < len(quals):
                quals[at - 1] = value[1]
            seq.append(text)
            _append(cigar, "M", len(text))
            read, ref = read + len(text), ref + len(text)
        elif code in "IiS":
            text = chr(value) if code == "i" else value.decode("latin-1")
            seq.append(text)
            _append(cigar, "S" if code == "S" else "I", len(text))
            read += len(text)
        else:
            _append(cigar, code, value)
            if code in "DN":
                ref += value
    match(length - read + 1)
    return ("" if omitted else "".join(seq)), cigar


def _join_mates(rows: list[dict], downstream: list[int]) -> None:
    """Mates of a slice: the other end is distance + 1 records on."""
    for i, distance in enumerate(downstream):
        j = i + distance + 1
        if distance < 0 or j >= len(rows):
            continue
        a, b = rows[i], rows[j]
        a["next_ref_id"], a["next_pos"], b["next_ref_id"], b["next_pos"] = b["ref_id"], b["pos"], a["ref_id"], a["pos"]
        a["tlen"] = b["tlen"] = 0
        if a["ref_id"] == b["ref_id"] >= 0:
            ends = [r["pos"] + sum(o["len"] for o in r["cigar"] if o["op"] in REFERENCE_OPS) for r in (a, b)]
            size = max(ends) - min(a["pos"], b["pos"])
            if size > 0:
                a["tlen"], b["tlen"] = (size, -size) if a["pos"] <= b["pos"] else (-size, size)


def _slices(path: str, c: Container, slices: set[int] | None) -> Iterator[tuple[int, Compression, Cursor, list[Block]]]:
    """(offset in the container, compression header, slice header, blocks) of a container's slices."""
    with open(path, "rb") as f:
        f.seek(c.body)
        cursor = Cursor(f.read(c.length))
    comp = parse_compression(parse_block(cursor).data)
    while cursor.at < len(cursor.data):
        at = cursor.at
        head = Cursor(parse_block(cursor).data)
        counter = Cursor(head.data)
        for _ in range(4):
            counter.itf8()
        counter.ltf8()
        blocks = [parse_block(cursor) for _ in range(counter.itf8())]
        if slices is None or at in slices:
            yield at, comp, head, blocks


def read_container(path: str, c: Container, header: Header, fasta: Fasta | None, wanted=None, slices: set[int] | None = None) -> Iterator[tuple[int, list[dict]]]:
    """(offset of the slice in the container, rows) of its slices."""
    bases = Bases(fasta, header)
    for at, comp, head, blocks in _slices(path, c, slices):
        yield at, decode_slice(header, comp, blocks, head, bases, wanted)


def read_batches(path: str, c: Container, header: Header, fasta: Fasta | None, wanted=None, slices: set[int] | None = None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(offset of the slice in the container, rows) of its slices, whole series at a time where they allow it."""
    bases = Bases(fasta, header)
    for at, comp, head, blocks in _slices(path, c, slices):
        try:
            cram_columns.check(not comp.reference or fasta is None)
            got = cram_columns.decode(header, comp, {b.content_id: b.data for b in blocks if b.kind == EXTERNAL}, Cursor(head.data), wanted)
        except cram_columns.Unusual:
            rows = decode_slice(header, comp, blocks, head, bases, wanted)
            got = batch([row | {"file_ord": None, "rec_no": None, "voffset": None} for row in rows], None)
        yield at, got


# --- encoding ------------------------------------------------------------------------------

_NUMBERS = ("BF", "CF", "RI", "RL", "AP", "RG", "MF", "NS", "NP", "TS", "TL", "FN", "FP", "DL", "RS", "PD", "HC", "MQ")
_BYTES = ("FC", "BS", "BA", "QS")
_ARRAYS = ("IN", "BB", "SC")
_IDS = {key: i for i, key in enumerate(("RN", *_NUMBERS, *_BYTES, *_ARRAYS, *(k + "-length" for k in _ARRAYS)), 1)}


@dataclass
class Encoded:
    """A container without its header, which gets its number when the file is put together."""

    body: bytes
    ref_id: int
    start: int
    span: int
    records: int
    bases: int
    blocks: int
    landmark: int
    slices: list[tuple[int, int, int]]  # (reference, start, span) for the CRAI
    size: int = 0  # of a body that lies in a part file
    path: str = ""
    at: int = 0


def encode_container(rows: list[dict], header: Header, fasta: Fasta | None = None, methods: tuple[int, ...] = (K.GZIP,)) -> Encoded:
    """One container with one slice of the rows."""
    series: dict[str, bytearray] = {k: bytearray() for k in _IDS}
    groups = {g.key: i for i, g in enumerate(header.read_groups)}
    lists: dict[tuple, int] = {}
    tag_data: dict[int, tuple[bytearray, bytearray]] = {}
    refs = {r["ref_id"] for r in rows}
    slice_ref = refs.pop() if len(refs) == 1 else -2
    extent: dict[int, tuple[int, int]] = {}
    n_bases, bases = 0, Bases(fasta, header)

    def put(key: str, x: int) -> None:
        series[key] += itf8(x)

    def put_array(key: str, x: bytes) -> None:
        series[key] += x
        series[key + "-length"] += itf8(len(x))

    for r in rows:
        seq, qual = r["seq"] or "", r["qual"]
        cigar = [(o["op"], o["len"]) for o in r["cigar"] or ()]
        query = sum(k for op, k in cigar if op in QUERY_OPS)
        mapped = not r["flag"] & S.UNMAPPED
        length = len(seq) or (query if mapped else 0)
        n_bases += length
        put("BF", r["flag"])
        put("CF", DETACHED | (QUALITY_ARRAY if length else 0) | (0 if seq or not length else NO_SEQUENCE))
        put("RI", r["ref_id"])
        put("RL", length)
        put("AP", r["pos"] + 1)
        tags = {k: (v if isinstance(v, dict) else v.asDict()) for k, v in (r["tags"] or {}).items()}
        group = groups.get((tags.get("RG") or {}).get("s"), -1)
        put("RG", group)
        series["RN"] += (r["qname"] or "").encode("latin-1") + b"\0"
        put("MF", (1 if r["flag"] & S.MATE_REVERSE else 0) | (2 if r["flag"] & S.MATE_UNMAPPED else 0))
        put("NS", r["next_ref_id"])
        put("NP", r["next_pos"] + 1)
        put("TS", r["tlen"])
        kinds = []
        for key in sorted(tags):
            if key == "RG" and group >= 0:
                continue
            coded = encode_tag(key, tags[key])
            kinds.append(coded[:3])
            sizes, body = tag_data.setdefault(int.from_bytes(coded[:3], "big"), (bytearray(), bytearray()))
            sizes += itf8(len(coded) - 3)
            body += coded[3:]
        put("TL", lists.setdefault(tuple(kinds), len(lists)))
        end = r["pos"] + 1
        if mapped:
            features = _features(cigar, seq, r["ref_id"], r["pos"], bases if fasta else None)
            put("FN", len(features))
            before = 0
            for code, at, key, value in features:
                series["FC"].append(ord(code))
                put("FP", at - before)
                before = at
                if key in _ARRAYS:
                    put_array(key, value)
                elif key in _BYTES:
                    series[key].append(value)
                else:
                    put(key, value)
            put("MQ", r["mapq"])
            end = max(end, r["pos"] + sum(k for op, k in cigar if op in REFERENCE_OPS))
        else:
            series["BA"] += seq.encode("latin-1")
        if length:
            series["QS"] += bytes(qual) if qual is not None else bytes([NO_QUALITY]) * length
        if r["ref_id"] >= 0:
            low, high = extent.get(r["ref_id"], (r["pos"], end))
            extent[r["ref_id"]] = min(low, r["pos"]), max(high, end)
    got = cram_columns.Gathered(series, lists, tag_data, extent, slice_ref, len(rows), n_bases, any(r["ref_id"] < 0 for r in rows))
    return _container(got, bases if fasta else None, methods)


def encode_columns(batch: pa.RecordBatch, header: Header, methods: tuple[int, ...] = (K.GZIP,)) -> Encoded:
    """encode_container, without a reference, of the rows of a batch."""
    try:
        got = cram_columns.gather(batch, _IDS, {g.key: i for i, g in enumerate(header.read_groups)})
    except cram_columns.Unusual:
        return encode_container(rows_of_batch(batch), header, None, methods)
    return _container(got, None, methods)


def _container(got: cram_columns.Gathered, bases: Bases | None, methods: tuple[int, ...]) -> Encoded:
    """The container of a slice's series; bases: the reference, if there is one."""
    series, tag_data, extent, slice_ref = got.series, got.tag_data, got.extent, got.slice_ref
    start, span = 0, 0
    if slice_ref >= 0:
        start, span = extent[slice_ref][0] + 1, extent[slice_ref][1] - extent[slice_ref][0]
    dictionary = b"".join(b"".join(kinds) + b"\0" for kinds in got.lists)
    keep = b"RN\1AP\0RR" + (b"\1" if bases else b"\0") + b"SM" + bytes([0b00011011] * 5) + b"TD" + itf8(len(dictionary)) + dictionary
    keep = itf8(5) + keep
    entries = [b"RN" + K.array_stop(0, _IDS["RN"])]
    entries += [k.encode() + K.external(_IDS[k]) for k in (*_NUMBERS, *_BYTES)]
    entries += [k.encode() + K.array_length(_IDS[k + "-length"], _IDS[k]) for k in _ARRAYS]
    maps = itf8(len(entries)) + b"".join(entries)
    # The lengths of a tag's values have a block of their own, whose number has the tag's and a high bit.
    tag_maps = itf8(len(tag_data)) + b"".join(itf8(k) + K.array_length(k | 1 << 24, k) for k in tag_data)
    comp = b"".join(itf8(len(m)) + m for m in (keep, maps, tag_maps))
    blocks = [format_block(CORE, 0, b"")]
    blocks += [format_block(EXTERNAL, _IDS[k], bytes(v), methods) for k, v in series.items() if v]
    for k, (sizes, body) in tag_data.items():
        blocks += [format_block(EXTERNAL, k | 1 << 24, bytes(sizes), methods), format_block(EXTERNAL, k, bytes(body), methods)]
    ids = [_IDS[k] for k, v in series.items() if v] + [i for k in tag_data for i in (k | 1 << 24, k)]
    # Blocks without data are written too where a reader might look for them.
    for k, v in series.items():
        if not v:
            blocks.append(format_block(EXTERNAL, _IDS[k], b""))
            ids.append(_IDS[k])
    md5 = b"\0" * 16
    if bases and slice_ref >= 0:
        md5 = hashlib.md5(bases.get(slice_ref, start - 1, start - 1 + span).encode()).digest()
    head = itf8(slice_ref) + itf8(start) + itf8(span) + itf8(got.records) + ltf8(0) + itf8(len(blocks)) + itf8(len(ids)) + b"".join(map(itf8, ids)) + itf8(-1) + md5
    first = format_block(COMPRESSION_HEADER, 0, comp, (K.GZIP,))
    body = first + format_block(SLICE_HEADER, 0, head) + b"".join(blocks)
    spans = [(i, low + 1, high - low) for i, (low, high) in sorted(extent.items())]
    if got.unplaced:
        spans.append((-1, 0, 0))
    return Encoded(body, slice_ref, start, span, got.records, got.bases, len(blocks) + 2, len(first), spans)


def _features(cigar, seq: str, ref_id: int, pos: int, bases: Bases | None) -> list[tuple]:
    """(code, read position, series, value) of what differs from the reference, or without one of all bases."""
    out, read, ref = [], 1, pos
    for op, n in cigar:
        part = seq[read - 1 : read - 1 + n]
        if op in "M=X":
            if not seq:
                pass
            elif bases is None:
                out.append(("b", read, "BB", part.encode("latin-1")))
            else:
                for k, (own, base) in enumerate(zip(part, bases.get(ref_id, ref, ref + n), strict=True)):
                    if own != base:
                        if base in SUBSTITUTIONS and own in SUBSTITUTIONS[base]:
                            out.append(("X", read + k, "BS", SUBSTITUTIONS[base].index(own)))
                        else:
                            out.append(("b", read + k, "BB", own.encode("latin-1")))
            read, ref = read + n, ref + n
        elif op in "IS":
            out.append((op, read, "IN" if op == "I" else "SC", part.encode("latin-1") if seq else b"N" * n))
            read += n
        else:
            out.append((op, read, {"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[op], n))
            ref += n if op in "DN" else 0
    return out


def file_start(header: Header, name: str = "readloom", minor: int = 0) -> bytes:
    """File definition and header container; minor: 1 for a file with block methods of version 3.1."""
    text = header.to_text().encode()
    block = format_block(FILE_HEADER, 0, struct.pack("<i", len(text)) + text, (K.GZIP,))
    return b"CRAM\3" + bytes([minor]) + name.encode()[:20].ljust(20, b"\0") + format_container(len(block), 0, 0, 0, 0, 0, 0, 1, [0]) + block


def assemble(spark: SparkSession | None, path: str, header: Header, encoded: list[Encoded], methods: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    """Writes a file of containers, whose bodies are at hand or lie in part files, in order; the rows of its CRAI."""
    index, counter, pieces = [], 0, [parts.Piece(file_start(header, minor=int(max(methods, default=0) >= M31.NX16)))]
    at = len(pieces[0].head)
    for e in encoded:
        size = len(e.body) + e.size
        head = format_container(size, e.ref_id, e.start, e.span, e.records, counter, e.bases, e.blocks, [e.landmark])
        pieces.append(parts.Piece(head + e.body, e.path, e.at, e.size))
        index += [(ref, start, span, at, e.landmark, size - e.landmark) for ref, start, span in e.slices]
        counter += e.records
        at += len(head) + size
    parts.join(spark, path, [*pieces, parts.Piece(EOF)])
    return index


# --- the data source -----------------------------------------------------------------------


M31.register()


@dataclass
class ContainerPart(InputPartition):
    path: str
    file_ord: int
    container: Container
    slices: frozenset[int] | None = None


class CramReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = expand(options["path"])
        self.reference = options.get("reference") or os.environ.get(REFERENCE_VARIABLE)
        self.wanted = tag_filter(options.get("keep_tags"), options.get("drop_tags"))
        self.columns = frozenset(options["columns"].split(",")) if options.get("columns") else None
        self.slice = tuple(map(int, options["slice"].split(":"))) if options.get("slice") else None
        self.ref_id: int | None = None
        self.end: int | None = None
        self.headers = [read_header(p) for p in self.paths]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ref_id",):
                self.ref_id = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("pos",):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.end = end if self.end is None else min(self.end, end)
            yield f

    def partitions(self) -> list[ContainerPart]:
        from readloom.sources.indexes import read_crai

        out = []
        for i, path in enumerate(self.paths):
            slices: dict[int, set[int]] | None = None
            if self.ref_id is not None and os.path.exists(path + ".crai"):
                slices = {}
                for ref, start, span, at, slice_at, _ in read_crai(path + ".crai"):
                    if ref == self.ref_id and (ref < 0 or self.end is None or start - 1 < self.end):
                        slices.setdefault(at, set()).add(slice_at)
            for c in containers(path)[1]:
                if self.slice is not None:
                    if c.offset == self.slice[0]:
                        out.append(ContainerPart(path, i, c, frozenset(self.slice[1:]) or None))
                elif slices is not None:
                    if c.offset in slices:
                        out.append(ContainerPart(path, i, c, frozenset(slices[c.offset])))
                elif self.ref_id is None or c.ref_id in (-2, self.ref_id):
                    if c.ref_id < 0 or self.ref_id is None or self.end is None or c.start - 1 < self.end:
                        out.append(ContainerPart(path, i, c))
        return out

    def read(self, partition: ContainerPart) -> Iterator[pa.RecordBatch]:
        header = self.headers[partition.file_ord]
        fasta, c = Fasta(self.reference) if self.reference else None, partition.container
        done = 0
        for at, rows in read_batches(partition.path, c, header, fasta, self.wanted, partition.slices):
            n = rows.num_rows
            first = c.counter + done if partition.slices is None else None
            numbers = pa.nulls(n, pa.int64()) if first is None else pa.array(range(first, first + n), pa.int64())
            places = {"file_ord": pa.repeat(pa.scalar(partition.file_ord, pa.int32()), n), "rec_no": numbers, "voffset": pa.repeat(pa.scalar(c.offset << 16 | at & 0xFFFF, pa.int64()), n)}
            done += n
            arrays = [places.get(f.name, x) for f, x in zip(rows.schema, rows.columns, strict=True)]
            if self.columns is not None:
                arrays = [x if f.name in self.columns else pa.nulls(n, f.type) for f, x in zip(rows.schema, arrays, strict=True)]
            whole = pa.RecordBatch.from_arrays(arrays, schema=rows.schema)
            for i in range(0, n, BATCH_ROWS):
                yield whole.slice(i, BATCH_ROWS)


@dataclass
class Part(WriterCommitMessage):
    order: int
    containers: list[Encoded]  # without their bodies


def method_numbers(text: str | None) -> tuple[int, ...]:
    """Numbers of block methods from a comma-separated list, by default gzip."""
    return tuple(int(m) for m in (text or str(K.GZIP)).split(","))


def sliced(batches: Iterator[pa.RecordBatch], records: int, bases: int) -> Iterator[pa.RecordBatch]:
    """The rows again, cut behind the row that fills a slice."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        sizes = pc.fill_null(pc.utf8_length(b.column("seq")), 0).to_numpy(zero_copy_only=False).cumsum()
        at = before = 0
        while at < b.num_rows:
            end = min(at + records - n, at + 1 + int(sizes[at:].searchsorted(before + bases - size)), b.num_rows)
            held.append(b.slice(at, end - at))
            n, size, at, before = n + end - at, size + int(sizes[end - 1]) - before, end, int(sizes[end - 1])
            if n >= records or size >= bases:
                yield _joined(held)
                held, n, size = [], 0, 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


class CramWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.header = parse_header(options.get("header", "@HD\tVN:1.6\n"))
        self.reference = options.get("reference") or None
        self.crai = options.get("crai", "false").lower() == "true"
        self.methods = method_numbers(options.get("methods"))
        self.records, self.bases = int(options.get("slice_records", SLICE_RECORDS)), int(options.get("slice_bases", SLICE_BASES))
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.work = options.get("work") or f"{self.path}.parts-{uuid.uuid4().hex}"
        self.later = "work" in options  # the caller joins the parts

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.work, exist_ok=True)
        path = f"{self.work}/{context.partitionId()}-{context.taskAttemptId()}"
        fasta = Fasta(self.reference) if self.reference else None
        done: list[Encoded] = []
        with open(path, "wb") as f:
            for rows in sliced(iterator, self.records, self.bases):
                e = encode_columns(rows, self.header, self.methods) if fasta is None else encode_container(rows_of_batch(rows), self.header, fasta, self.methods)
                done.append(replace(e, body=b"", size=len(e.body), path=path, at=f.tell()))
                f.write(e.body)
        return Part(context.partitionId(), done)

    def commit(self, messages: list[Part | None]) -> None:
        encoded = [e for m in sorted((m for m in messages if m), key=lambda m: m.order) for e in m.containers]
        if self.later:
            os.makedirs(self.work, exist_ok=True)
            with open(f"{self.work}/containers", "wb") as f:
                pickle.dump(encoded, f)
            return
        finish(None, self.path, self.header, encoded, self.crai, self.methods)
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


def finish(spark: SparkSession | None, path: str, header: Header, encoded: list[Encoded], crai: bool, methods: tuple[int, ...]) -> None:
    from readloom.sources.indexes import write_crai

    index = assemble(spark, path, header, encoded, methods)
    if crai:
        write_crai(index, path + ".crai")


class CramDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cram"

    def schema(self) -> StructType:
        return S.READS

    def reader(self, schema: StructType) -> CramReader:
        return CramReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> CramWriter:
        return CramWriter(dict(self.options), overwrite)


def read_cram(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    from readloom.sources.bam import register

    register(spark)
    reader = spark.read.format("cram")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path if isinstance(path, str) else ",".join(path))


def write_cram(reads: DataFrame, path: str, header: Header, **options) -> None:
    """Writes reads in partition order. Options: reference, crai, methods, slice_records, slice_bases."""
    from readloom.sources.bam import register

    register(reads.sparkSession)
    writer = reads.select(S.READS.fieldNames()).write.format("cram").option("header", header.to_text())
    for k, v in options.items():
        writer = writer.option(k, str(v))
    path = path.removeprefix("file://")
    work = f"{path}.parts-{uuid.uuid4().hex}"
    writer.option("work", work).mode("overwrite").save(path)
    with open(f"{work}/containers", "rb") as f:
        encoded = pickle.load(f)  # noqa: S301  written by the commit of this job
    finish(reads.sparkSession, path, header, encoded, str(options.get("crai", "false")).lower() == "true", method_numbers(options.get("methods")))
    shutil.rmtree(work, ignore_errors=True)


def read_header(path: str) -> Header:
    return containers(path, first=True)[0]
