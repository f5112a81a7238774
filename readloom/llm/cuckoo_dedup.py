"""Exact dedup on a cuckoo-filter index.

Each task keeps a ``CuckooIndex``: a cuckoo filter of 16-bit fingerprints answers most
lookups with "new"; a hit is verified against the full keys stored in the bucket, so a
false positive never merges two texts; an insertion that overflows doubles the table and
rebuilds it from the stored keys; a key whose last live row is retired is deleted.

Plan: SHA-256 in the JVM -> one index per input partition folds that partition's copies
(so a group holding a third of all rows reaches the exchange as one row per partition)
-> exchange on the digest -> one index per partition folds the partial groups -> join
back on the digest, a sort-merge join whose skewed side AQE may split. Text never
crosses an exchange.

Defined cases: a null text equals the empty text; null ids lose against any id; of
rows that tie in text and id one stays (the last in scan order); texts of any length are digested whole;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize, small_or_shuffled

#: Keys that a pre-aggregating index holds before it emits what it has and starts anew.
LOCAL_KEYS = 200_000
#: Digests that one task of the global stage should hold.
KEYS_PER_TASK = 200_000


class CuckooFilter:
    """Set of 16-bit fingerprints, each in one of two buckets of four slots."""

    SLOTS, KICKS = 4, 120

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        self.table = array("H", bytes(2 * buckets * self.SLOTS))
        self._turn = 1

    def place(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint and both buckets of a key (a uniform digest of 10 bytes or more)."""
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x9E3779B1 >> 7 & self.mask)

    def _slot(self, bucket: int, mark: int) -> int:
        at = bucket * self.SLOTS
        table = self.table
        for i in range(at, at + self.SLOTS):
            if table[i] == mark:
                return i
        return -1

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self.place(key)
        return self._slot(a, mark) >= 0 or self._slot(b, mark) >= 0

    def add(self, key: bytes) -> bool:
        """False if the table overflowed: one fingerprint is then homeless and the table must be rebuilt."""
        mark, a, b = self.place(key)
        for bucket in (a, b):
            if (i := self._slot(bucket, 0)) >= 0:
                self.table[i] = mark
                return True
        bucket = b
        for _ in range(self.KICKS):
            self._turn = (self._turn * 1103515245 + 12345) & 0x7FFFFFFF
            i = bucket * self.SLOTS + (self._turn >> 16) % self.SLOTS
            mark, self.table[i] = self.table[i], mark
            bucket = self._other(bucket, mark)
            if (i := self._slot(bucket, 0)) >= 0:
                self.table[i] = mark
                return True
        return False

    def discard(self, key: bytes) -> bool:
        """Removes one copy of the key's fingerprint; only keys that were added may be given."""
        mark, a, b = self.place(key)
        for bucket in (a, b):
            if (i := self._slot(bucket, mark)) >= 0:
                self.table[i] = 0
                return True
        return False


class CuckooIndex:
    """Map from digest to a mutable record, with a cuckoo filter in front of bucketed keys."""

    def __init__(self, buckets: int = 64):
        self.filter = CuckooFilter(buckets)
        self.bucketed: list[list | None] = [None] * buckets
        self.live = 0
        self.resizes = 0

    def __len__(self) -> int:
        return self.live

    def get(self, key: bytes):
        """The record of a key, or None; a filter hit is checked against the stored keys."""
        if key not in self.filter:
            return None
        for stored, record in self.bucketed[self.filter.place(key)[1]] or ():
            if stored == key:
                return record
        return None

    def put(self, key: bytes, record) -> None:
        """Adds a key that is not in the index."""
        first = self.filter.place(key)[1]
        if self.bucketed[first] is None:
            self.bucketed[first] = []
        self.bucketed[first].append((key, record))
        self.live += 1
        if not self.filter.add(key):
            self._resize()

    def delete(self, key: bytes) -> bool:
        """Removes a live key; False if it isn't there."""
        first = self.filter.place(key)[1]
        held = self.bucketed[first] or []
        for i, (stored, _) in enumerate(held):
            if stored == key:
                held.pop(i)
                self.live -= 1
                return self.filter.discard(key)
        return False

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self.bucketed:
            yield from held or ()

    def _resize(self) -> None:
        kept, buckets = list(self.items()), len(self.bucketed)
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            if all(self.filter.add(key) for key, _ in kept):
                break
        self.bucketed = [None] * buckets
        for item in kept:
            first = self.filter.place(item[0])[1]
            if self.bucketed[first] is None:
                self.bucketed[first] = []
            self.bucketed[first].append(item)
        self.resizes += 1


GROUP = pa.schema([("digest", pa.binary()), ("best_id", pa.int64()), ("best_row", pa.int64()), ("n", pa.int64())])
_GROUP_DDL = "digest binary, best_id bigint, best_row bigint, n bigint"


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = [(key, *record) for key, record in index.items()]
    for i in range(0, len(rows), 20_000):
        part = list(zip(*rows[i : i + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, GROUP, strict=True)], schema=GROUP)


def _fold(batches: Iterable[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Groups of equal digests; with most, an index of that many keys is emitted and begun anew.

    A row of n 0 is retired: its key is inserted, and deleted at the end unless a live row shares it.
    """
    index = CuckooIndex()
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in GROUP.names)
        for key, best_id, row, n in zip(*columns, strict=True):
            record = index.get(key)
            if record is None:
                if most and len(index) >= most:
                    yield from _emit(index)
                    index = CuckooIndex()
                index.put(key, [best_id, row, n])
                continue
            record[2] += n
            if n and (record[2] == n or (-1 if best_id is None else best_id, row) > (-1 if record[0] is None else record[0], record[1])):
                record[0], record[1] = best_id, row
    if not most:
        for key in [key for key, record in index.items() if record[2] == 0]:
            index.delete(key)
    yield from _emit(index)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", retired: DataFrame | None = None) -> DataFrame:
    """One row per live row of docs: doc_id, keep_id, group_size, kept, text_sha256 (and row_ref, the row's ordinal).

    retired: ids whose rows are deleted from the index first; they get no row in the result.
    """
    spark = docs.sparkSession
    skinny = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_ref"),
    )
    if retired is not None:
        gone = retired.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct().withColumn("gone", F.lit(True))
        skinny = skinny.join(gone, "doc_id", "left").withColumn("live", F.col("gone").isNull().cast("bigint")).drop("gone")
    else:
        skinny = skinny.withColumn("live", F.lit(1).cast("bigint"))
    skinny = materialize(skinny)
    partial = skinny.select("digest", F.col("doc_id").alias("best_id"), F.col("row_ref").alias("best_row"), F.col("live").alias("n")).mapInArrow(
        lambda batches: _fold(batches, LOCAL_KEYS), _GROUP_DDL
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(skinny.count() / KEYS_PER_TASK))
    groups = partial.repartition(tasks, "digest").mapInArrow(lambda batches: _fold(batches, None), _GROUP_DDL)
    return (
        skinny.where("live = 1")
        .join(groups, "digest")
        .select(
            "doc_id",
            F.col("best_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("row_ref") == F.col("best_row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "row_ref",
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns kept.

    The dropped rows, ids and digests, are anti-joined: by broadcast up to BROADCAST_ROWS of them, so that
    text is exchanged beyond that number only. The id is part of the key, so a large group of copies spreads
    over the tasks.
    """

    def id_of(column: str):
        return F.coalesce(F.col(column).cast("bigint"), F.lit(-(2**63)))

    key = ["_sha", "_id"]
    dropped = exact_dedup(docs, id_col, text_col).where("not kept")
    lost = materialize(dropped.select(F.col("text_sha256").alias("_sha"), id_of("doc_id").alias("_id"), id_of("keep_id").alias("_keep")), merge=True)
    tagged = docs.withColumns({"_sha": F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), "_id": id_of(id_col)})
    kept = tagged.join(small_or_shuffled(lost.where("_id <> _keep").select(key)), key, "left_anti")
    twins = lost.where("_id = _keep").select(key).distinct()
    n = twins.count()
    if n:  # rows equal in id and text, of which one stays
        twins = small_or_shuffled(materialize(twins, merge=True), n)
        kept = kept.join(twins, key, "left_anti").unionByName(kept.join(twins, key, "left_semi").dropDuplicates(key))
    return kept.drop(*key)
