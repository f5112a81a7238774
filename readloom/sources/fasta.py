"""FASTA with its .fai index: a data source of sequences and a window reader."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

WINDOW = 1 << 20
SCHEMA = StructType([StructField("name", StringType()), StructField("start", LongType()), StructField("length", IntegerType()), StructField("seq", StringType())])
_ARROW = pa.schema([("name", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("seq", pa.string())])


@dataclass(frozen=True)
class Sequence:
    """A line of an .fai; even is false where lines differ in length, and the sequence is then read whole."""

    name: str
    length: int
    offset: int
    line_bases: int
    line_bytes: int
    even: bool = True


def read_fai(path: str) -> list[Sequence]:
    out = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip():
                name, *numbers = line.rstrip("\r\n").split("\t")
                out.append(Sequence(name, *map(int, numbers[:4])))
    return out


def scan(path: str) -> list[Sequence]:
    """The sequences of a FASTA file in one pass."""
    out: list[Sequence] = []
    name, length, offset, bases, width, even, last = None, 0, 0, 0, 0, True, False

    def close() -> None:
        if name is not None:
            out.append(Sequence(name, length, offset, bases, width, even))

    with open(path, "rb") as f:
        for line in f:
            if line.startswith(b">"):
                close()
                words = line[1:].split()
                name, length, offset, bases, width, even, last = words[0].decode() if words else "", 0, f.tell(), 0, 0, True, False
            elif name is not None:
                n = len(line.strip())
                if not bases:
                    bases, width = n, len(line)
                elif last or n > bases or (len(line) != width and n == bases and line.endswith(b"\n")):
                    even = even and n == 0
                last = last or n < bases
                length += n
    close()
    return out


def index(path: str) -> list[Sequence]:
    """The .fai beside a file, else a scan; gzip files have no sequences to seek in."""
    with open(path, "rb") as f:
        if f.read(2) == b"\x1f\x8b":
            return []
    return read_fai(path + ".fai") if os.path.exists(path + ".fai") else scan(path)


def write_fai(path: str) -> str:
    with open(path + ".fai", "w", encoding="utf-8") as f:
        f.writelines(f"{s.name}\t{s.length}\t{s.offset}\t{s.line_bases}\t{s.line_bytes}\n" for s in scan(path))
    return path + ".fai"


class Fasta:
    """Bases of windows of a file."""

    def __init__(self, path: str):
        self.path = path
        self.sequences = {s.name: s for s in index(path)}

    def fetch(self, name: str, beg: int, end: int) -> str:
        """Bases [beg, end), cut at the sequence's end, in upper case."""
        s = self.sequences.get(name)
        if s is None:
            raise KeyError(f"no sequence {name} in {self.path}")
        beg, end = max(beg, 0), min(end, s.length)
        if beg >= end:
            return ""
        with open(self.path, "rb") as f:
            if not s.even:
                f.seek(s.offset)
                got, lines = 0, []
                while got < end and (line := f.readline()) and not line.startswith(b">"):
                    lines.append(line.strip())
                    got += len(lines[-1])
                return b"".join(lines)[beg:end].decode().upper()
            first = s.offset + beg // s.line_bases * s.line_bytes + beg % s.line_bases
            last = s.offset + (end - 1) // s.line_bases * s.line_bytes + (end - 1) % s.line_bases + 1
            f.seek(first)
            return f.read(last - first).translate(None, b"\r\n \t").decode().upper()


@dataclass
class Window(InputPartition):
    name: str
    start: int
    end: int


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.window = int(options.get("window", WINDOW))

    def partitions(self) -> list[Window]:
        return [Window(s.name, b, min(b + self.window, s.length)) for s in index(self.path) for b in range(0, max(s.length, 1), self.window)]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        seq = Fasta(self.path).fetch(partition.name, partition.start, partition.end)
        yield pa.RecordBatch.from_pylist([{"name": partition.name, "start": partition.start, "length": len(seq), "seq": seq}], schema=_ARROW)


class FastaDataSource(DataSource):
    """name, start, length, seq: windows of a FASTA file's sequences."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(dict(self.options))
