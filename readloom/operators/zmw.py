"""Molecule (ZMW) grouping, lookups, whitelists and exact chunks."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.hashing import MASK64, SplitMix
from readloom.functions.ordinals import with_neighbour, with_ordinal, with_running_sum
from readloom.functions.storage import materialize

IDENTITY = ["rg_id", "zmw"]
#: Records of one numbering range.
RANGE_RECORDS = 1 << 16
#: Tiles up to which a scatter permutation is drawn, four bytes each: as many as the format's 32-bit counts allow.
MOST_TILES = (1 << 31) - 1


def zmw_point(index: DataFrame, zmw: int) -> DataFrame:
    """Records of a hole number in any read group."""
    return index.where(F.col("zmw") == zmw)


def identity_batch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the wanted identities (rg_id, zmw, req): in request order by req, then file order."""
    return index.join(wanted, IDENTITY)


def first_offset(index: DataFrame) -> DataFrame:
    """rg_id, zmw, voffset of the first record of each identity."""
    return index.groupBy(*IDENTITY).agg(F.min_by("voffset", "rec_no").alias("voffset"))


def unique_zmws(index: DataFrame) -> DataFrame:
    """rg_id, zmw, first_rec and n_records of each identity: the order of first_rec is that of first sight."""
    return index.groupBy(*IDENTITY).agg(F.min("rec_no").alias("first_rec"), F.count("*").alias("n_records"))


def count_zmws(index: DataFrame) -> DataFrame:
    return index.select(*IDENTITY).distinct().agg(F.count("*").alias("n_zmws"))


def zmw_runs(reads: DataFrame, width: int = RANGE_RECORDS) -> DataFrame:
    """reads with run_id: consecutive records of one identity share it (numbered from 1 in record order).

    The neighbour and the running sum are found in ranges of record numbers, so no task sees the whole table. reads is
    read twice, its identities for the totals of the ranges and all of it for the result.
    """
    identity = F.struct(*IDENTITY)
    marked = with_neighbour(reads, "rec_no", -1, identity, "_before", width=width)
    marked = marked.withColumn("_new", F.when(F.col("_before") == identity, 0).otherwise(1)).drop("_before")
    return with_running_sum(marked, F.expr(f"rec_no div {width}"), [F.col("rec_no")], F.col("_new"), "run_id").drop("_new")


def zmw_groups(reads: DataFrame) -> DataFrame:
    """One row per run of consecutive records: run_id, rg_id, zmw and the records (rec_no, qname) in order."""
    return zmw_runs(reads).groupBy("run_id", *IDENTITY).agg(F.sort_array(F.collect_list(F.struct("rec_no", "qname"))).alias("records"))


def whitelist(reads: DataFrame, wanted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Reads whose identity (or the given keys) is in wanted, each once."""
    keys = keys or IDENTITY
    return reads.join(wanted.select(*keys).distinct(), keys, "left_semi")


def numbered_zmws(index: DataFrame, width: int = RANGE_RECORDS) -> DataFrame:
    """unique_zmws with zmw_no: 0, 1, ... in the order of first sight."""
    unique = unique_zmws(index)
    return with_ordinal(unique, F.expr(f"first_rec div {width}"), [F.col("first_rec")], "zmw_no")


def boundary(count: int, k: int, n: int) -> int:
    """floor(count * k / n)."""
    return count * k // n


def contiguous_chunk(index: DataFrame, k: int, n: int) -> DataFrame:
    """Records of chunk k of n: the molecules [N(k-1)/n, Nk/n) in the order of first sight."""
    if not (n >= 1 and 1 <= k <= n):
        raise ValueError(f"chunk number must be in [1, {n}], got {k}")
    numbered = materialize(numbered_zmws(index))
    total = numbered.count()
    chosen = numbered.where((F.col("zmw_no") >= boundary(total, k - 1, n)) & (F.col("zmw_no") < boundary(total, k, n)))
    return index.join(chosen.select(*IDENTITY, "zmw_no"), IDENTITY)


def permutation(n: int, seed: int) -> array:
    """Fisher-Yates over 0..n-1 driven by a SplitMix64 stream whose first number is thrown away."""
    out, stream = array("i", range(n)), SplitMix(seed)
    stream.next()
    for i in range(n - 1, 0, -1):
        bound = i + 1
        under = (MASK64 + 1) % bound  # numbers under this would favour small remainders
        while (value := stream.next()) < under:
            pass
        j = value % bound
        out[i], out[j] = out[j], out[i]
    return out


def scatter_tiles(total: int, k: int, n: int, tile: int, seed: int) -> np.ndarray:
    """Tiles of chunk k of n, ascending: a slice of the shuffled tiles of tile molecules each."""
    if not (n >= 1 and 1 <= k <= n):
        raise ValueError(f"chunk number must be in [1, {n}], got {k}")
    if tile < 1:
        raise ValueError(f"tile must be at least 1, got {tile}")
    tiles = -(-total // tile)
    if tiles > MOST_TILES:
        raise ValueError(f"{tiles} tiles are too many to shuffle; use tiles of at least {-(-total // MOST_TILES)} molecules")
    order = permutation(tiles, seed)
    return np.sort(np.frombuffer(order, dtype=np.int32)[boundary(tiles, k - 1, n) : boundary(tiles, k, n)]) if tiles else np.zeros(0, dtype=np.int32)


def scatter_chunk(index: DataFrame, k: int, n: int, tile: int = 1, seed: int = 0) -> DataFrame:
    """Records of the molecules in the chunk's tiles, which are joined as a table of tile numbers."""
    spark = index.sparkSession
    numbered = materialize(numbered_zmws(index))
    total = numbered.count()
    tiles = spark.createDataFrame(pa.table({"tile": scatter_tiles(total, k, n, tile, seed).astype(np.int64)}), "tile bigint")
    chosen = numbered.withColumn("tile", F.expr(f"zmw_no div {tile}")).join(tiles, "tile", "left_semi")
    return index.join(chosen.select(*IDENTITY, "zmw_no"), IDENTITY)


def barcode_pairs(index: DataFrame) -> DataFrame:
    """fwd, rev of each ordered pair with its number of records."""
    return index.groupBy("fwd", "rev").agg(F.count("*").alias("n_records"))


def barcode_offsets(index: DataFrame, fwd: int, rev: int) -> DataFrame:
    """rec_no and voffset of the records of an ordered barcode pair."""
    return index.where((F.col("fwd") == fwd) & (F.col("rev") == rev)).select("rec_no", "voffset")
