"""BAM as a Spark data source.

Reading: a partition is a range of file bytes. Its task finds its first block and in it the first
record by the chain of plausible records that follows, decodes the records that begin in its range
and reads on for the end of the last one, so no pass over the file is needed first. With a BAI
beside the file, filters on ref_id and pos become ranges of blocks. Options: keep_tags, drop_tags
(comma-separated), columns (what to decode), split_bytes, start_voffset, limit.

Writing: each task writes its records as BGZF blocks into a part file beside the output; then
tasks copy the header, the parts in partition order and the end marker to their places in a temporary
file that is renamed (a plain save(), without write_bam, has the commit copy them). Options: header, the header's text; compression; split_tag: the output is then a folder with a
file for each value of that tag (none.bam for records without it), all written in one pass.

Paths are read and written with open(), so they must be on storage that all executors mount;
read_binary() decodes files that only Spark can reach.
"""

from __future__ import annotations

import glob
import os
import pickle
import re
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from readloom import schema as S
from readloom.header import Header, parse_bam_header, parse_header
from readloom.sources import bgzf, parts
from readloom.sources.columns import array_of, rows_of_batch
from readloom.sources.records import decode_record, encode_record, find_record

SPLIT_BYTES = 32 << 20
BATCH_ROWS = 2000
#: Bytes that a writing task holds for all its outputs.
HELD_BYTES = 64 << 20
_TAG_ARROW = pa.struct([("t", pa.string()), ("i", pa.int64()), ("f", pa.float32()), ("s", pa.string()), ("et", pa.string()), ("ai", pa.list_(pa.int64())), ("af", pa.list_(pa.float32()))])
ARROW = pa.schema(
    [
        ("file_ord", pa.int32()),
        ("rec_no", pa.int64()),
        ("voffset", pa.int64()),
        ("qname", pa.string()),
        ("flag", pa.int32()),
        ("ref_id", pa.int32()),
        ("rname", pa.string()),
        ("pos", pa.int32()),
        ("mapq", pa.int16()),
        ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))),
        ("next_ref_id", pa.int32()),
        ("next_rname", pa.string()),
        ("next_pos", pa.int32()),
        ("tlen", pa.int32()),
        ("seq", pa.string()),
        ("qual", pa.binary()),
        ("tags", pa.map_(pa.string(), _TAG_ARROW)),
    ]
)


def expand(path: str | list[str]) -> list[str]:
    """Files of a path, a comma-separated list or a pattern, in order."""
    out = []
    for part in path.split(",") if isinstance(path, str) else path:
        local = part.removeprefix("file://")
        out += sorted(glob.glob(local)) if glob.has_magic(local) else [local]
    return out


def read_header(path: str) -> tuple[Header, int]:
    """Header of a BAM file and the virtual offset of its first record."""
    data, starts = b"", []
    with open(path, "rb") as f:
        for at, block in bgzf.blocks(f):
            starts.append((at, len(data)))
            data += block
            try:
                header, size = parse_bam_header(data)
            except IndexError:
                continue
            if size < len(data):
                at, before = next(x for x in reversed(starts) if x[1] <= size)
                return header, bgzf.pack(at, size - before)
            end = f.tell()
            return header, bgzf.pack(end, 0)
    raise ValueError(f"truncated BAM header in {path}")


def batch(rows: list[dict], columns: frozenset[str] | None) -> pa.RecordBatch:
    """Rows as an Arrow batch of the reads schema; columns that aren't wanted are null."""
    arrays = []
    for f in ARROW:
        if columns is not None and f.name not in columns:
            arrays.append(pa.nulls(len(rows), f.type))
        else:
            arrays.append(array_of([r[f.name] for r in rows], f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches of the reads schema."""
    for b in batches:
        yield from rows_of_batch(b)


@dataclass
class Range(InputPartition):
    """Bytes [start, stop) of a file, or the records that begin in virtual offsets [first, last)."""

    path: str
    file_ord: int
    start: int
    stop: int
    first: int | None = None
    last: int | None = None


def records(part: Range, n_ref: int, first_record: int, name_of, wanted, size: int) -> Iterator[dict]:
    """Rows of the records that begin in a range."""
    with open(part.path, "rb") as f:
        if part.first is not None:
            begin = part.first
            start = bgzf.unpack(begin)[0]
        else:
            start = bgzf.next_block(f, part.start, size)
            begin = first_record if bgzf.pack(start, 0) <= first_record else None
            if begin is not None:
                start = bgzf.unpack(begin)[0]
        limit = part.last if part.last is not None else bgzf.pack(part.stop, 0)
        stream = bgzf.blocks(f, start)
        data, at, marks = b"", 0, []  # marks: where in data the data of each block begins (the first may lie before it)

        def more() -> bool:
            nonlocal data, at, marks
            got = next(stream, None)
            if got is None:
                return False
            last = max((i for i, (m, _) in enumerate(marks) if m <= at), default=0)
            marks = [(m - at, b) for m, b in marks[last:]]
            data, at = data[at:], 0
            marks.append((len(data), got[0]))
            data += got[1]
            return True

        if begin is not None:
            more()
            at = bgzf.unpack(begin)[1]
        else:
            while len(data) < 1 << 18 and more():
                pass
            at = find_record(data, n_ref)
            if at < 0:
                if data:
                    raise ValueError(f"no record found after offset {start} of {part.path}")
                return
        while True:
            while at + 4 > len(data) and more():
                pass
            if at >= len(data):
                return
            while len(marks) > 1 and marks[1][0] <= at:
                marks.pop(0)
            voffset = bgzf.pack(marks[0][1], at - marks[0][0])
            if voffset >= limit:
                return
            if at + 4 > len(data):
                raise ValueError(f"truncated record in {part.path}")
            (length,) = struct.unpack_from("<I", data, at)
            while at + 4 + length > len(data):
                if not more():
                    raise ValueError(f"truncated record in {part.path}")
            row = decode_record(data, at + 4, length, name_of, wanted)
            row |= {"file_ord": part.file_ord, "rec_no": None, "voffset": voffset}
            yield row
            at += 4 + length


def tag_filter(keep: str | None, drop: str | None):
    kept = frozenset(keep.split(",")) if keep else None
    dropped = frozenset(drop.split(",")) if drop else frozenset()
    if kept is None and not dropped:
        return None
    return _Wanted(kept, dropped)


@dataclass(frozen=True)
class _Wanted:
    kept: frozenset[str] | None
    dropped: frozenset[str]

    def __call__(self, key: str) -> bool:
        return (self.kept is None or key in self.kept) and key not in self.dropped


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = expand(options["path"])
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted = tag_filter(options.get("keep_tags"), options.get("drop_tags"))
        self.columns = frozenset(options["columns"].split(",")) if options.get("columns") else None
        self.first = int(options["start_voffset"]) if options.get("start_voffset") else None
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.ref_id: int | None = None
        self.end: int | None = None
        self.headers = [read_header(p) for p in self.paths]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on ref_id and upper bounds on pos choose blocks; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ref_id",):
                self.ref_id = f.value
            elif isinstance(f, LessThan) and f.attribute == ("pos",):
                self.end = f.value if self.end is None else min(self.end, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("pos",):
                self.end = f.value + 1 if self.end is None else min(self.end, f.value + 1)
            yield f

    def partitions(self) -> list[Range]:
        from readloom.sources.indexes import read_bai

        out = []
        for i, path in enumerate(self.paths):
            size, first = os.path.getsize(path), self.headers[i][1]
            bai = next((b for b in (path + ".bai", os.path.splitext(path)[0] + ".bai") if os.path.exists(b)), None)
            if self.ref_id is not None and self.ref_id >= 0 and bai and os.path.getmtime(bai) >= os.path.getmtime(path):
                out += [Range(path, i, 0, size, beg, end) for beg, end in read_bai(bai).chunks(self.ref_id, 0, self.end or S.INT_MAX)]
                continue
            if self.first is not None:
                out.append(Range(path, i, 0, size, self.first, bgzf.pack(size, 0)))
                continue
            starts = range(0, size, self.split)
            out += [Range(path, i, s, min(s + self.split, size)) for s in starts]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        header, first = self.headers[partition.file_ord]
        rows, n = [], 0
        for row in records(partition, len(header.references), first, header.reference_name, self.wanted, os.path.getsize(partition.path)):
            rows.append(row)
            n += 1
            if len(rows) >= BATCH_ROWS:
                yield batch(rows, self.columns)
                rows = []
            if self.limit is not None and n >= self.limit:  # no more than limit of any partition is needed
                break
        if rows:
            yield batch(rows, self.columns)


@dataclass
class Part(WriterCommitMessage):
    order: int
    paths: dict[str, str]  # part file of each output


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.header = parse_header(options.get("header", "@HD\tVN:1.6\n"))
        self.level = int(options.get("compression", 6))
        self.split = options.get("split_tag")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.work = options.get("work") or f"{self.path}.parts-{uuid.uuid4().hex}"
        self.later = "work" in options  # the caller joins the parts

    def output(self, row) -> str:
        """Name of the output that a record goes to."""
        if self.split is None:
            return ""
        value = (row["tags"] or {}).get(self.split)
        if value is None:
            return "none.bam"
        parts = [x for x in (value["s"], value["i"], value["f"]) if x is not None] or value["ai"] or value["af"] or []
        return re.sub(r"[^A-Za-z0-9.+=-]", "_", "--".join(map(str, parts))) + ".bam"

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        os.makedirs(self.work, exist_ok=True)
        held: dict[str, bytearray] = {}
        paths: dict[str, str] = {}
        waiting = 0

        def flush(name: str, data: bytes) -> None:
            # Opened for each block, so that many outputs need no open files.
            with open(paths.setdefault(name, f"{self.work}/{part}-{attempt}-{len(paths)}"), "ab") as f:
                f.write(bgzf.deflate(data, self.level))

        for row in rows_of(iterator):
            name = self.output(row)
            data = held.setdefault(name, bytearray())
            record = encode_record(row)
            data += record
            waiting += len(record)
            while len(data) >= bgzf.BLOCK_DATA:
                flush(name, bytes(data[: bgzf.BLOCK_DATA]))
                del data[: bgzf.BLOCK_DATA]
                waiting -= bgzf.BLOCK_DATA
            if waiting > HELD_BYTES:  # many outputs: shorter blocks, not more memory
                for other, rest in held.items():
                    if rest:
                        flush(other, bytes(rest))
                held, waiting = {}, 0
        for name, data in held.items():
            if data:
                flush(name, bytes(data))
        return Part(part, paths)

    def commit(self, messages: list[Part | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.order)
        names = sorted({n for m in done for n in m.paths}) if self.split is not None else [""]
        outputs = {name: [m.paths[name] for m in done if name in m.paths] for name in names}
        if self.later:
            os.makedirs(self.work, exist_ok=True)
            with open(f"{self.work}/outputs", "wb") as f:
                pickle.dump(outputs, f)
        else:
            join_outputs(None, self.path, outputs, self.header, self.level, self.split is not None)
            shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


def join_outputs(spark: SparkSession | None, path: str, outputs: dict[str, list[str]], header: Header, level: int, folder: bool) -> None:
    if folder:
        os.makedirs(path, exist_ok=True)
    head, end = parts.Piece(bgzf.compress(header.to_bam(), level, end=False)), parts.Piece(bgzf.EOF)
    for name, paths in outputs.items():
        parts.join(spark, f"{path}/{name}" if name else path, [head, *map(parts.whole, paths), end])


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> StructType:
        return S.READS

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Registers all formats of the library and lets Spark offer them filters."""
    from readloom.sources.cram import CramDataSource
    from readloom.sources.fasta import FastaDataSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)
    spark.dataSource.register(CramDataSource)
    spark.dataSource.register(FastaDataSource)


def read_bam(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Reads of one or more BAM files with equal references; rec_no is null (see numbered)."""
    register(spark)
    reader = spark.read.format("bam")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path if isinstance(path, str) else ",".join(path))


def numbered(reads: DataFrame, span: int = 1 << 40) -> DataFrame:
    """reads with rec_no 0, 1, ... within each file, in file order, without a window over a whole file."""
    starts = reads.groupBy("file_ord", F.expr(f"voffset div {span}").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_ord").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("file_ord", "_r", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("file_ord", "_r").orderBy("voffset")) - 1
    return reads.withColumn("_r", F.expr(f"voffset div {span}")).join(starts, ["file_ord", "_r"]).withColumn("rec_no", (F.col("_before") + inside).cast("bigint")).drop("_r", "_before")


def write_bam(reads: DataFrame, path: str, header: Header, compression: int = 6, split_tag: str | None = None) -> None:
    """Writes reads in partition order: sort first where the file is to be sorted. split_tag: one file for each value."""
    register(reads.sparkSession)
    columns = [c for c in S.READS.fieldNames() if c in reads.columns]
    full = reads.select(columns)
    for f in S.READS.fields:
        if f.name not in columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    writer = full.select(S.READS.fieldNames()).write.format("bam").option("header", header.to_text()).option("compression", compression)
    if split_tag:
        writer = writer.option("split_tag", split_tag)
    path = path.removeprefix("file://")
    work = f"{path}.parts-{uuid.uuid4().hex}"
    writer.option("work", work).mode("overwrite").save(path)
    with open(f"{work}/outputs", "rb") as f:
        outputs = pickle.load(f)  # noqa: S301  written by the commit of this job
    join_outputs(reads.sparkSession, path, outputs, header, compression, split_tag is not None)
    shutil.rmtree(work, ignore_errors=True)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Reads of whole files that Spark loads itself, one file to a task; for stores that open() can't reach."""

    def decode(batches):
        for b in batches:
            for order, content in zip(b.column("file_ord").to_pylist(), b.column("content").to_pylist(), strict=True):
                data = bgzf.decompress(content)
                header, at = parse_bam_header(data)
                rows = []
                while at < len(data):
                    (length,) = struct.unpack_from("<I", data, at)
                    rows.append(decode_record(data, at + 4, length, header.reference_name) | {"file_ord": order, "rec_no": None, "voffset": at})
                    at += 4 + length
                    if len(rows) >= BATCH_ROWS:
                        yield batch(rows, None)
                        rows = []
                if rows:
                    yield batch(rows, None)

    files = spark.read.format("binaryFile").load(path).select(F.lit(0).alias("file_ord"), "content")
    return files.mapInArrow(decode, S.READS)
