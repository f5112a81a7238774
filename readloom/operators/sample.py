"""Deterministic sub-sampling by fraction of names or by yield of molecules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions import hashing as H
from readloom.functions.storage import materialize

#: Buckets of one running-sum range of the yield histogram.
RANGE_BUCKETS = 1 << 12


def fraction_sample(reads: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Reads whose name falls into the fraction; mates and parts of a read stay together."""
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    return reads.where(H.name_bucket(F.col("qname"), H.scrambled_seed(seed)) < H.fraction_cutoff(fraction))


def zmw_bucket(rg_id: Column, zmw: Column, seed: int = 0) -> Column:
    """The 24-bit bucket of a molecule: the top bits of a mix of its identity and the seed."""
    both = F.shiftleft(rg_id.cast("bigint"), 32).bitwiseOR(zmw.cast("bigint").bitwiseAND(H.MASK32))
    seeded = both.bitwiseXOR(F.lit(H.signed64((seed & H.MASK32) * H.GOLDEN)))
    return F.shiftrightunsigned(H.mix64(seeded), 40)


def zmw_bucket_py(rg_id: int, zmw: int, seed: int = 0) -> int:
    both = (rg_id & H.MASK32) << 32 | zmw & H.MASK32
    return H.mix64_py(both ^ ((seed & H.MASK32) * H.GOLDEN & H.MASK64)) >> 40


def yield_histogram(reads: DataFrame, seed: int = 0) -> DataFrame:
    """bucket, records, bases: the bases (column qlen) of each bucket that has any."""
    return reads.groupBy(zmw_bucket(F.col("rg_id"), F.col("zmw"), seed).alias("bucket")).agg(F.count("*").alias("records"), F.sum("qlen").cast("bigint").alias("bases"))


def yield_cutoff(histogram: DataFrame, target: int) -> int:
    """The smallest cutoff whose buckets hold target bases, else all buckets.

    Two levels: sums of ranges of buckets (at most 4096 rows) find the range, and only its rows are
    summed one by one; one number comes back.
    """
    ranges = histogram.groupBy(F.expr(f"bucket div {RANGE_BUCKETS}").alias("r")).agg(F.sum("bases").alias("b"))
    upto = ranges.select("r", "b", F.sum("b").over(Window.orderBy("r")).alias("upto"))
    hit = upto.where(F.col("upto") >= target).orderBy("r").take(1)
    if not hit:
        return H.BUCKETS
    before = hit[0]["upto"] - hit[0]["b"]
    inside = histogram.where(F.expr(f"bucket div {RANGE_BUCKETS}") == hit[0]["r"]).select("bucket", (F.sum("bases").over(Window.orderBy("bucket")) + before).alias("upto"))
    return inside.where(F.col("upto") >= target).agg(F.min("bucket").alias("b")).first()["b"] + 1


def yield_sample(reads: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """Whole molecules in bucket order until their bases reach target."""
    cutoff = yield_cutoff(materialize(yield_histogram(reads, seed)), target)  # one row a bucket, used twice
    return reads.where(zmw_bucket(F.col("rg_id"), F.col("zmw"), seed) < cutoff)


def kept_counts(reads: DataFrame, kept: Column) -> DataFrame:
    """records, bases, kept_records, kept_bases: one row."""
    return reads.agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum("qlen"), F.lit(0)).cast("bigint").alias("bases"),
        F.count_if(kept).alias("kept_records"),
        F.coalesce(F.sum(F.when(kept, F.col("qlen"))), F.lit(0)).cast("bigint").alias("kept_bases"),
    )


def parse_yield(text: str) -> int:
    """Bases with an optional suffix K, M, G or T of powers of 1000; fractions are rounded."""
    m = re.fullmatch(r"([0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)([kKmMgGtT]?)", text)
    bases = float(m[1]) * 1000.0 ** (" kmgt".index(m[2].lower()) if m[2] else 0) if m else 0.0
    if not 1.0 <= bases <= 9e18:
        raise ValueError(f"invalid yield: {text}")
    return int(bases + 0.5)


def parse_memory(text: str) -> int:
    """Bytes with an optional suffix K, M, G or T of powers of 1024."""
    m = re.fullmatch(r"([0-9]+)([kKmMgGtT]?)[bB]?", text)
    if not m or not int(m[1]):
        raise ValueError(f"invalid memory size: {text}")
    return int(m[1]) * 1024 ** (" kmgt".index(m[2].lower()) if m[2] else 0)
