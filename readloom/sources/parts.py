"""One file from the parts that tasks wrote: copied to their places by tasks, never through one process.

The driver holds one row for each piece (a part, or a CRAM container), not its bytes. A copy writes the same
bytes to the same place however often it is tried, and the file gets its name when all of them are there.
Parts and target must be on storage that all executors mount.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources import bgzf

#: Bytes that one copy moves at most; targets up to it are put together by the driver.
COPY_BYTES = 64 << 20
_STEP = 4 << 20


@dataclass(frozen=True)
class Piece:
    """head, then size bytes of a part file from start on."""

    head: bytes = b""
    path: str = ""
    start: int = 0
    size: int = 0


def whole(path: str) -> Piece:
    return Piece(path=path, size=os.path.getsize(path))


def _copy(rows: Iterable[dict], target: str) -> int:
    done = 0
    with open(target, "r+b") as out:
        for row in rows:
            out.seek(row["at"])
            done += out.write(row["head"])
            if not row["n"]:
                continue
            with open(row["src"], "rb") as f:
                f.seek(row["beg"])
                left = row["n"]
                while left:
                    data = f.read(min(left, _STEP))
                    if not data:
                        raise ValueError(f"part {row['src']} is shorter than it was")
                    done += out.write(data)
                    left -= len(data)
    return done


def join(spark: SparkSession | None, target: str, pieces: Iterable[Piece]) -> int:
    """Writes target from pieces in order; its size. Without spark, or for a small target, this process copies."""
    rows, at = [], 0
    for p in pieces:
        head = p.head
        for beg in range(p.start, max(p.start + p.size, p.start + 1), COPY_BYTES):
            n = min(COPY_BYTES, p.start + p.size - beg)
            rows.append({"src": p.path, "beg": beg, "n": n, "at": at, "head": head})
            at += n + len(head)
            head = b""
    temporary = f"{target}.tmp-{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.truncate(at)
    if spark is None or at <= COPY_BYTES:
        done = _copy(rows, temporary)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([_copy(batch.to_pylist(), temporary)])], names=["n"])

        table = spark.createDataFrame(rows, "src string, beg bigint, n bigint, at bigint, head binary")
        tasks = min(len(rows), 4 * spark.sparkContext.defaultParallelism)
        done = table.repartition(tasks).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]
    if done != at:
        raise ValueError(f"{done} of {at} bytes of {target} were copied")
    os.replace(temporary, target)
    return at


def write_entries(rows: DataFrame, entry, work: str) -> list[tuple[str, int]]:
    """BGZF part files of the rows in partition order, (path, rows) of each; entry(batch) gives the bytes of a batch's rows.

    A part's last block may be short; blocks need not be full for a reader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(work, exist_ok=True)
        path, n, held = f"{work}/{context.partitionId()}-{context.taskAttemptId()}", 0, bytearray()
        with open(path, "wb") as f:
            for batch in batches:
                held += entry(batch)
                n += batch.num_rows
                cut = len(held) - len(held) % bgzf.BLOCK_DATA
                f.write(bgzf.compress(bytes(held[:cut]), end=False))
                del held[:cut]
            f.write(bgzf.compress(bytes(held), end=False))
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([path]), pa.array([n])], names=["part", "path", "n"])

    done = rows.mapInArrow(run, "part bigint, path string, n bigint").collect()  # one row a partition
    return [(r["path"], r["n"]) for r in sorted(done, key=lambda r: r["part"])]
