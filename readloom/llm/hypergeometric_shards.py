"""Uniform sharding with exact sizes by a hypergeometric communication matrix.

The driver draws how many rows each input partition sends to each shard: row p of the
matrix is multivariate hypergeometric given the capacity that the shards have left, so
the matrix is distributed as under a uniform permutation of all rows. Each partition
permutes its rows and deals them out by its row of the matrix; after the exchange every
shard is permuted again, by a random 64-bit key in blocks of bounded size, which gives
each row its slot.

Law ``rows``: shard sizes differ by one at most; ``grown_shard`` is null. The documents
themselves are exchanged, with all columns; shard_rows() derives their sizes and checksums
from what arrives. The matrix is one small row per partition.

Defined cases: a null text has size 8 and the checksum of no bytes; ids may be null or
repeated (rows are placed by position, so equal rows are rows of their own and nothing ties but random keys,
which the position breaks); texts of any length move whole; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.common import materialize, shared_dir, small_or_shuffled

SHARDS, SEED = 24, 20240229
#: Rows that one block of a shard should hold when it is permuted after the exchange.
BLOCK_ROWS = 250_000
#: Constant of the row's own size that is added to its text.
ROW_BYTES = 8

def capacities(rows: int, shards: int) -> np.ndarray:
    """Shard sizes, at most one apart."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], dtype=np.int64)


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows that partition p sends to shard k; row sums are counts, column sums are sizes."""
    left, rng = sizes.astype(np.int64).copy(), np.random.Generator(np.random.Philox(key=seed))
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        # numpy takes totals under 10**9 only; beyond it rows are drawn in steps.
        matrix[p] = rng.multivariate_hypergeometric(left, n, method="marginals") if left.sum() < 10**9 else _in_steps(rng, left, n)
        left -= matrix[p]
    return matrix


def _in_steps(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw for totals that numpy doesn't take.

    The rows of a step fall on places of the room that is left, drawn independently; a step with a place drawn
    twice is drawn anew, so the places are those of a draw without replacement.
    """
    out = np.zeros_like(left)
    while n:
        room = left - out
        step = min(n, max(1, int(room.sum() // 10**6)))
        places = rng.integers(0, room.sum(), size=step)
        if len(np.unique(places)) < step:
            continue
        out += np.bincount(np.searchsorted(np.cumsum(room), places, side="right"), minlength=len(left))
        n -= step
    return out


def _deal(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Shard and random key of the rows at ref in part, which is permuted and dealt out by its row of the matrix.

    The deal needs the place of a row in its partition only, so documents stream by.
    """
    now, shard, mix = None, None, None
    for parts, refs, deals, seeds in batches:
        part, place = parts.to_numpy(), refs.to_numpy() & ((1 << 33) - 1)
        out_shard, out_mix = np.zeros(len(part), dtype=np.int32), np.zeros(len(part), dtype=np.int64)
        ends = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(part)] if len(part) else []
        for at, end in itertools.pairwise(ends):
            if part[at] != now:
                now, counts = part[at], np.asarray(deals.iloc[at])
                rng = np.random.Generator(np.random.Philox(key=[int(seeds.iloc[at]), int(now) + 1]))
                order = rng.permutation(int(counts.sum()))
                shard, mix = np.empty(len(order), dtype=np.int32), np.empty(len(order), dtype=np.int64)
                shard[order] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                mix[order] = rng.integers(-(2**63), 2**63 - 1, size=len(order), dtype=np.int64)
            out_shard[at:end], out_mix[at:end] = shard[place[at:end]], mix[place[at:end]]
        yield pd.DataFrame({"shard": out_shard, "mix": out_mix})


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with law, shard, slot and grown_shard; all other columns are kept, those named like the added ones replaced."""
    spark = docs.sparkSession
    path = shared_dir(spark) + "/documents"
    # What is written fixes which rows make up a partition and their places in it, for the counts and for the deal.
    docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("ref")).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("part", F.shiftright("ref", 33))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    sizes = capacities(sum(counts.values()), shards)
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    deal = spark.createDataFrame([(int(p), [int(x) for x in m]) for p, m in zip(parts, matrix, strict=True)], "part bigint, deal array<int>")
    # A broadcast join leaves the rows in their partition; beyond its bound they are exchanged and sorted by it.
    dealt = rows.join(small_or_shuffled(deal, len(parts)), "part").withColumn("dealt", F.pandas_udf(_deal, "shard int, mix bigint")("part", "ref", "deal", F.lit(seed).cast("bigint")))
    dealt = dealt.select("doc", "ref", "dealt.shard", "dealt.mix")
    blocks = max(1, math.ceil(int(sizes.max(initial=0)) / BLOCK_ROWS))
    # Exchange: a block is a range of the random key within a shard, so blocks in order make the shard's permutation.
    width = F.lit(float(2**64) / blocks)
    dealt = dealt.withColumn("block", F.least(F.lit(blocks - 1), ((F.col("mix").cast("double") + float(2**63)) / width).cast("int")))
    starts = materialize(dealt.groupBy("shard", "block").agg(F.count("*").alias("n")), merge=True)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = starts.select("shard", "block", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("mix", "ref")) - 1
    placed = dealt.withColumn("within", within).join(small_or_shuffled(starts, shards * blocks), ["shard", "block"])
    added = {
        "law": F.lit("rows"),
        "shard": F.col("shard"),
        "slot": (F.col("start") + F.col("within")).cast("bigint"),
        "grown_shard": F.lit(None).cast("int"),
    }
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return placed.select(*kept, *(c.alias(n) for n, c in added.items()))


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What shard_documents() gives, each document as doc_id, size, text_crc32: with law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return shard_documents(docs, shards, seed).select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        "grown_shard",
    )
