"""Index files: BAI, CRAI, ZMI and PBI, read to driver objects or DataFrames and written from them."""

from __future__ import annotations

import gzip
import os
import shutil
import struct
import uuid
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from readloom import schema as S
from readloom.functions.cigar import bins_of
from readloom.operators.index import METADATA_BIN, WINDOW_SHIFT
from readloom.sources import bgzf, parts

ZMI_MAGIC, ZMI_HEADER, ZMI_VERSION = b"ZMI\1", 64, 0x010100
PBI_MAGIC, PBI_HEADER = b"PBI\1", 32
BARCODE_RANGE = (-1, 65535)


@dataclass
class BaiReference:
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)
    meta: tuple[int, int, int, int] | None = None  # least and largest offset, mapped, unmapped


@dataclass
class Bai:
    references: list[BaiReference] = field(default_factory=list)
    no_coordinate: int = 0

    def chunks(self, ref_id: int, beg: int, end: int) -> list[tuple[int, int]]:
        """Merged file ranges that may hold reads of [beg, end)."""
        if not 0 <= ref_id < len(self.references) or end <= max(beg, 0):
            return []
        own, beg = self.references[ref_id], max(beg, 0)
        least = own.linear[min(beg >> WINDOW_SHIFT, len(own.linear) - 1)] if own.linear else 0
        found = sorted(c for b in bins_of(beg, end) for c in own.bins.get(b, ()) if c[1] > least)
        out: list[list[int]] = []
        for b, e in found:
            if out and b <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([b, e])
        return [(b, e) for b, e in out]

    def counts(self) -> tuple[int, int, int]:
        """Mapped, unmapped (placed or not) and unplaced records."""
        metas = [r.meta for r in self.references if r.meta]
        return sum(m[2] for m in metas), sum(m[3] for m in metas) + self.no_coordinate, self.no_coordinate


def read_bai(path: str) -> Bai:
    with open(path, "rb") as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"not a BAI file: {path}")
    at = 4

    def take(form: str):
        nonlocal at
        try:
            got = struct.unpack_from("<" + form, data, at)
        except struct.error as e:
            raise ValueError(f"truncated BAI file: {path}") from e
        at += struct.calcsize("<" + form)
        return got

    out = Bai()
    for _ in range(take("i")[0]):
        ref = BaiReference()
        for _ in range(take("i")[0]):
            number, n = take("Ii")
            flat = take(f"{2 * n}Q")
            pairs = list(zip(flat[::2], flat[1::2], strict=True))
            if number == METADATA_BIN:
                ref.meta = (*pairs[0], *pairs[1])
            else:
                ref.bins[number] = pairs
        ref.linear = list(take(f"{take('i')[0]}Q"))
        out.references.append(ref)
    if at + 8 <= len(data):
        out.no_coordinate = take("Q")[0]
    return out


def write_bai(bai: Bai, path: str) -> None:
    out = [b"BAI\1", struct.pack("<i", len(bai.references))]
    for ref in bai.references:
        bins = dict(ref.bins)
        if ref.meta:
            bins[METADATA_BIN] = [ref.meta[:2], ref.meta[2:]]
        out.append(struct.pack("<i", len(bins)))
        for number in sorted(bins):
            out.append(struct.pack("<Ii", number, len(bins[number])))
            out += [struct.pack("<QQ", *c) for c in bins[number]]
        out.append(struct.pack(f"<i{len(ref.linear)}Q", len(ref.linear), *ref.linear))
    out.append(struct.pack("<Q", bai.no_coordinate))
    _replace(path, b"".join(out))


def _replace(path: str, data: bytes) -> None:
    with open(path + ".tmp", "wb") as f:
        f.write(data)
    os.replace(path + ".tmp", path)


def build_bai(reads: DataFrame, references: int) -> Bai:
    """Index of a coordinate-sorted file from its reads with voffset and end_voffset.

    The parts are aggregated by Spark; the index itself, bins and 16 KiB windows of the genome, is small.
    """
    from readloom.operators import index as I

    out = Bai([BaiReference() for _ in range(references)])
    for r in I.bai_bins(reads).orderBy("ref_id", "bin", "beg").toLocalIterator():
        out.references[r["ref_id"]].bins.setdefault(r["bin"], []).append((r["beg"], r["end"]))
    for r in I.bai_linear(reads).orderBy("ref_id", "win").toLocalIterator():
        linear = out.references[r["ref_id"]].linear
        linear += [0] * (r["win"] + 1 - len(linear))
        linear[r["win"]] = r["voffset"]
    for r in I.bai_meta(reads).collect():
        out.references[r["ref_id"]].meta = (r["beg"], r["end"], r["n_mapped"], r["n_unmapped"])
    out.no_coordinate = I.no_coordinate_count(reads).first()["n_no_coor"]
    return out


def build_bam_index(spark: SparkSession, path: str) -> str:
    """Builds path.bai; the header must say that the file is sorted by coordinate."""
    from readloom.functions.storage import materialize
    from readloom.operators.index import with_end_offset
    from readloom.operators.sort import disorder
    from readloom.sources.bam import numbered, read_bam, read_header

    header, _ = read_header(path)
    if header.sort_order != "coordinate":
        raise ValueError(f"{path} is not sorted by coordinate (SO:{header.sort_order or 'none'})")
    # The file is decoded once; order, bins, windows and counts come from what is stored.
    rows = numbered(materialize(read_bam(spark, path, columns="file_ord,voffset,flag,ref_id,pos,cigar").select("file_ord", "voffset", "flag", "ref_id", "pos", "cigar")))
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        end = size - len(bgzf.EOF) if bgzf.has_eof_marker(f, size) else size
    rows = materialize(with_end_offset(rows, bgzf.pack(end, 0)))
    if disorder(rows).first()["n_out_of_order"]:
        raise ValueError(f"records of {path} are out of coordinate order")
    write_bai(build_bai(rows, len(header.references)), path + ".bai")
    return path + ".bai"


def ensure_bam_index(spark: SparkSession, path: str) -> str:
    """path.bai, built if it is missing or older than the file."""
    if os.path.exists(path + ".bai") and os.path.getmtime(path + ".bai") >= os.path.getmtime(path):
        return path + ".bai"
    return build_bam_index(spark, path)


def bai_frames(spark: SparkSession, bai: Bai) -> tuple[DataFrame, DataFrame]:
    """bins (ref_id, bin, beg, end) and linear (ref_id, win, voffset)."""
    bins = [(i, b, c[0], c[1]) for i, r in enumerate(bai.references) for b, cs in r.bins.items() for c in cs]
    linear = [(i, w, v) for i, r in enumerate(bai.references) for w, v in enumerate(r.linear)]
    return (
        spark.createDataFrame(bins, "ref_id int, bin int, beg bigint, end bigint"),
        spark.createDataFrame(linear, "ref_id int, win int, voffset bigint"),
    )


CRAI_DDL = "seq_id int, start bigint, span bigint, container bigint, slice bigint, size bigint"


def read_crai(path: str) -> list[tuple[int, ...]]:
    """Rows of a CRAI; several gzip members, line ends of any kind and plain text are read."""
    with open(path, "rb") as f:
        data = f.read()
    text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if line:
            fields = line.split("\t")
            if len(fields) != 6 or not all(x.lstrip("-").isdecimal() for x in fields):
                raise ValueError(f"invalid CRAI line {n}: {line}")
            out.append(tuple(map(int, fields)))
    return out


def crai_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(read_crai(path), CRAI_DDL)


def write_crai(rows: list[tuple[int, ...]], path: str) -> None:
    _replace(path, gzip.compress("".join("\t".join(map(str, r)) + "\n" for r in rows).encode(), mtime=0))


def read_zmi(path: str) -> pd.DataFrame:
    """rec_no, rg_id, zmw, voffset, fwd, rev, qlen (null) of a ZMI of either version; without barcodes they are null."""
    with open(path, "rb") as f:
        data = bgzf.decompress(f.read())
    if len(data) < ZMI_HEADER or data[:4] != ZMI_MAGIC:
        raise ValueError(f"not a ZMI file: {path}")
    version, stride, _, n = struct.unpack_from("<IHHQ", data, 4)
    coded = version >= ZMI_VERSION
    if stride < (24 if coded else 16):
        raise ValueError(f"ZMI entries of {stride} bytes are too small")
    if (len(data) - ZMI_HEADER) % stride or n not in (0, (len(data) - ZMI_HEADER) // stride):
        raise ValueError(f"truncated ZMI file: {path}")
    kinds = [("rg_id", "<i4"), ("zmw", "<i4"), ("voffset", "<i8")] + ([("fwd", "<i4"), ("rev", "<i4")] if coded else [])
    rest = stride - sum(np.dtype(k).itemsize for _, k in kinds)
    entries = np.frombuffer(data, dtype=np.dtype(kinds + ([("rest", f"V{rest}")] if rest else [])), offset=ZMI_HEADER)
    out = pd.DataFrame({name: entries[name] for name, _ in kinds})
    if coded and not (out[["fwd", "rev"]].ge(BARCODE_RANGE[0]) & out[["fwd", "rev"]].le(BARCODE_RANGE[1])).all(axis=None):
        raise ValueError("ZMI barcodes must be in [-1, 65535]")
    out.insert(0, "rec_no", np.arange(len(out)))
    return out.reindex(columns=S.ZMW_INDEX.fieldNames())


def read_pbi(path: str) -> pd.DataFrame:
    """The same columns from a PBI; qlen is the query length, barcodes are null."""
    with open(path, "rb") as f:
        data = bgzf.decompress(f.read())
    if len(data) < PBI_HEADER or data[:4] != PBI_MAGIC:
        raise ValueError(f"not a PBI file: {path}")
    (n,) = struct.unpack_from("<I", data, 10)
    if len(data) < PBI_HEADER + 29 * n:
        raise ValueError(f"truncated PBI file: {path}")
    starts = [PBI_HEADER + n * k for k in (0, 4, 8, 12, 21)]
    rg, begin, end, zmw = (np.frombuffer(data, "<i4", n, at) for at in starts[:4])
    voffset = np.frombuffer(data, "<i8", n, starts[4])
    out = pd.DataFrame({"rec_no": np.arange(n), "rg_id": rg, "zmw": zmw, "voffset": voffset, "qlen": end - begin})
    return out.reindex(columns=S.ZMW_INDEX.fieldNames())


#: Entries of an index that one task decodes.
INDEX_ENTRIES = 4_000_000


class Stretches:
    """Where the data of a BGZF file's blocks begins; the driver reads 22 bytes of each block (64 KiB of data)."""

    def __init__(self, path: str):
        self.path, self.places, self.starts, size = path, [], [], 0
        end = os.path.getsize(path)
        with open(path, "rb") as f:
            for at in bgzf.block_offsets(f, end):
                self.places.append(at)
                self.starts.append(size)
                f.seek(at)
                f.seek(at + bgzf.block_size(f.read(64)) - 4)
                size += struct.unpack("<I", f.read(4))[0]
        self.size = size

    def place(self, at: int) -> int:
        """Virtual offset of byte at of the data."""
        i = max(bisect_right(self.starts, at) - 1, 0)
        return bgzf.pack(self.places[i], at - self.starts[i]) if self.places else 0


def read_stretch(path: str, voffset: int, n: int) -> bytes:
    """n bytes of a BGZF file's data from a virtual offset on."""
    at, skip = bgzf.unpack(voffset)
    out, held = [], 0
    with open(path, "rb") as f:
        for _, data in bgzf.blocks(f, at) if n else ():
            out.append(data[skip : skip + n - held])
            held, skip = held + len(out[-1]), 0
            if held == n:
                break
    return b"".join(out)


def _index_frame(spark: SparkSession, path: str, n: int, columns: list[tuple[str, int, int, str]], stretches: Stretches) -> DataFrame:
    """An index of n entries decoded by tasks; columns: name, first byte, bytes from entry to entry, numpy type."""
    rows = [(first, min(INDEX_ENTRIES, n - first), [stretches.place(at + first * step) for _, at, step, _ in columns]) for first in range(0, n, INDEX_ENTRIES)]
    wanted = S.ZMW_INDEX.fieldNames()

    def run(batches):
        for batch in batches:
            for task in batch.to_pylist():
                first, count, found = task["first"], task["n"], {}
                for (name, _, step, kind), place in zip(columns, task["places"], strict=True):
                    size = np.dtype(kind).itemsize
                    data = np.frombuffer(read_stretch(path, place, (count - 1) * step + size).ljust(count * step, b"\0"), dtype=np.uint8)
                    found[name] = np.ascontiguousarray(data[: count * step].reshape(count, step)[:, :size]).view(kind).ravel()
                if "begin" in found:
                    found["qlen"] = found["end"] - found["begin"]
                if "fwd" in found and not all(((found[c] >= BARCODE_RANGE[0]) & (found[c] <= BARCODE_RANGE[1])).all() for c in ("fwd", "rev")):
                    raise ValueError("ZMI barcodes must be in [-1, 65535]")
                found["rec_no"] = np.arange(first, first + count)
                for at in range(0, count, 100_000):
                    arrays = [pa.array(found[c][at : at + 100_000], to_arrow_type(S.ZMW_INDEX[c].dataType)) if c in found else pa.nulls(min(100_000, count - at), to_arrow_type(S.ZMW_INDEX[c].dataType)) for c in wanted]
                    yield pa.RecordBatch.from_arrays(arrays, names=wanted)

    tasks = spark.createDataFrame(rows, "first bigint, n bigint, places array<bigint>")
    return tasks.repartitionByRange(max(1, len(rows)), "first").mapInArrow(run, S.ZMW_INDEX)


def zmi_frame(spark: SparkSession, path: str) -> DataFrame:
    """read_zmi as a DataFrame that tasks decode."""
    data = Stretches(path)
    head = read_stretch(path, data.place(0), min(ZMI_HEADER, data.size))
    if len(head) < ZMI_HEADER or head[:4] != ZMI_MAGIC:
        raise ValueError(f"not a ZMI file: {path}")
    version, stride, _, n = struct.unpack_from("<IHHQ", head, 4)
    coded = version >= ZMI_VERSION
    if stride < (24 if coded else 16):
        raise ValueError(f"ZMI entries of {stride} bytes are too small")
    if (data.size - ZMI_HEADER) % stride or n not in (0, (data.size - ZMI_HEADER) // stride):
        raise ValueError(f"truncated ZMI file: {path}")
    columns = [(name, ZMI_HEADER + ZMI_ENTRY.fields[name][1], stride, ZMI_ENTRY.fields[name][0].str) for name in ZMI_ENTRY.names if coded or name not in ("fwd", "rev")]
    return _index_frame(spark, path, (data.size - ZMI_HEADER) // stride, columns, data)


def pbi_frame(spark: SparkSession, path: str) -> DataFrame:
    """read_pbi as a DataFrame that tasks decode."""
    data = Stretches(path)
    head = read_stretch(path, data.place(0), min(PBI_HEADER, data.size))
    if len(head) < PBI_HEADER or head[:4] != PBI_MAGIC:
        raise ValueError(f"not a PBI file: {path}")
    (n,) = struct.unpack_from("<I", head, 10)
    if data.size < PBI_HEADER + 29 * n:
        raise ValueError(f"truncated PBI file: {path}")
    columns = [(name, PBI_HEADER + n * k, np.dtype(kind).itemsize, kind) for name, k, kind in (("rg_id", 0, "<i4"), ("begin", 4, "<i4"), ("end", 8, "<i4"), ("zmw", 12, "<i4"), ("voffset", 21, "<i8"))]
    return _index_frame(spark, path, n, columns, data)


def zmw_index(spark: SparkSession, bam: str) -> DataFrame:
    """The molecule index beside a BAM file: its .zmi, else its .pbi; decoded by tasks."""
    for suffix, read in ((".zmi", zmi_frame), (".pbi", pbi_frame)):
        if os.path.exists(bam + suffix):
            return read(spark, bam + suffix)
    raise FileNotFoundError(f"no ZMW index found for {bam}")


def write_zmi(rows, path: str) -> int:
    """Writes rows (rg_id, zmw, voffset, fwd, rev) in order; the number of records."""
    body, n = bytearray(), 0
    for rg, zmw, voffset, fwd, rev in rows:
        if not all(BARCODE_RANGE[0] <= b <= BARCODE_RANGE[1] for b in (fwd, rev)):
            raise ValueError("ZMI barcodes must be in [-1, 65535]")
        body += struct.pack("<iiqii", rg, zmw, voffset, fwd, rev)
        n += 1
    head = ZMI_MAGIC + struct.pack("<IHHQ", ZMI_VERSION, 24, 0, n)
    _replace(path, bgzf.compress(head.ljust(ZMI_HEADER, b"\0") + bytes(body)))
    return n


def write_pbi(rows, path: str) -> None:
    """Writes rows (rg_id, query start, query end, zmw, read quality, context, voffset)."""
    columns = list(zip(*rows, strict=True)) or [()] * 7
    n = len(columns[0])
    head = PBI_MAGIC + struct.pack("<IHI", 0x030001, 0, n)
    body = b"".join(np.asarray(c, dtype=k).tobytes() for c, k in zip(columns, ("<i4", "<i4", "<i4", "<i4", "<f4", "u1", "<i8"), strict=True))
    _replace(path, bgzf.compress(head.ljust(PBI_HEADER, b"\0") + body))


def zmi_columns(reads: DataFrame) -> DataFrame:
    """rg_id, zmw, voffset, fwd, rev of reads, as a ZMI has them."""
    from pyspark.sql import functions as F

    from readloom.functions.names import read_group_number, zmw_or_zero
    from readloom.functions.tags import barcodes, int_tag, text_tag

    pair = barcodes(F.col("tags"))
    return reads.select(
        "file_ord",
        "voffset",
        F.coalesce(read_group_number(text_tag(F.col("tags"), "RG")), F.lit(0)).alias("rg_id"),
        F.coalesce(int_tag(F.col("tags"), "zm").cast("int"), zmw_or_zero(F.col("qname"))).alias("zmw"),
        pair["fwd"].alias("fwd"),
        pair["rev"].alias("rev"),
    )


#: One entry of a ZMI.
ZMI_ENTRY = np.dtype([("rg_id", "<i4"), ("zmw", "<i4"), ("voffset", "<i8"), ("fwd", "<i4"), ("rev", "<i4")])


def write_zmi_frame(rows: DataFrame, path: str) -> int:
    """Writes rows (rg_id, zmw, voffset, fwd, rev) in partition order; entries are packed, and their parts joined, by tasks."""
    work = f"{path}.parts-{uuid.uuid4().hex}"

    def entry(batch) -> bytes:
        out = np.empty(batch.num_rows, dtype=ZMI_ENTRY)
        for name in ZMI_ENTRY.names:
            out[name] = batch.column(name).to_numpy(zero_copy_only=False)
        for name in ("fwd", "rev"):
            if ((out[name] < BARCODE_RANGE[0]) | (out[name] > BARCODE_RANGE[1])).any():
                raise ValueError("ZMI barcodes must be in [-1, 65535]")
        return out.tobytes()

    done = parts.write_entries(rows.select(*ZMI_ENTRY.names), entry, work)
    n = sum(k for _, k in done)
    head = ZMI_MAGIC + struct.pack("<IHHQ", ZMI_VERSION, ZMI_ENTRY.itemsize, 0, n)
    pieces = [parts.Piece(bgzf.compress(head.ljust(ZMI_HEADER, b"\0"), end=False)), *(parts.whole(p) for p, k in done if k), parts.Piece(bgzf.EOF)]
    parts.join(rows.sparkSession, path, pieces)
    shutil.rmtree(work, ignore_errors=True)
    return n


def build_zmi(spark: SparkSession, bam: str) -> str:
    """Writes bam.zmi from the file's records, whose partitions are in file order already."""
    from readloom.sources.bam import read_bam

    write_zmi_frame(zmi_columns(read_bam(spark, bam, keep_tags="RG,zm,bc", columns="file_ord,voffset,qname,tags")), bam + ".zmi")
    return bam + ".zmi"
