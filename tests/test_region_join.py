"""The bin join against all pairs, at lengths and densities where its levels and its shuffle matter."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import region

READS = "rec_no bigint, ref_id int, pos int, cigar array<struct<op:string,len:int>>"
SPANS = "interval_id bigint, ref_id int, beg bigint, end bigint"


def _data(seed: int, reads: int, intervals: int, top: int):
    draw = random.Random(seed)

    def length(most: int) -> int:
        return draw.choice((1, 7, 60, 110, 250, draw.randint(1, most)))

    rows = [(i, draw.randint(-1, 2), draw.randint(0, top), [("S", 3), ("M", length(top)), ("I", 2)] if i % 9 else []) for i in range(reads)]
    spans = [(i, draw.randint(0, 2), b := draw.randint(0, top), b + (length(top) if i % 7 else draw.choice((0, -5, 1 << 30)))) for i in range(intervals)]
    return rows, spans


def _pairs(rows, spans) -> list[tuple[int, int]]:
    ends = [(n, ref, pos, max(pos + sum(k for op, k in cigar if op == "M"), pos + 1)) for n, ref, pos, cigar in rows]
    return sorted((n, i) for n, ref, pos, end in ends for i, own, beg, fin in spans if ref >= 0 and ref == own and beg < fin and pos < fin and end > beg)


@pytest.mark.parametrize("most", [0, 10_000])
@pytest.mark.parametrize("top", [300, 100_000, 2**31 - 300])
def test_bin_join_against_all_pairs(spark, monkeypatch, top, most):
    monkeypatch.setattr(region, "BROADCAST_INTERVALS", most)
    rows, spans = _data(top, 300, 90, min(top, 10**9))
    rows += [(300, 1, 2**31 - 2, [("M", 1)])]
    spans += [(90, 1, 2**31 - 3, 2**31), (91, 2, 0, 2**40)]
    joined = region.bin_join(spark.createDataFrame(rows, READS), spark.createDataFrame(spans, SPANS))
    assert sorted(map(tuple, joined.select("rec_no", "interval_id").collect())) == _pairs(rows, spans)


def test_bin_join_without_intervals(spark):
    rows, _ = _data(1, 5, 0, 100)
    assert region.bin_join(spark.createDataFrame(rows, READS), spark.createDataFrame([], SPANS)).count() == 0


def test_bin_join_shuffles_many_intervals(spark):
    """A small estimate of the intervals must not bring their bins into the driver."""
    reads = spark.range(1000).select(F.col("id").alias("rec_no"), F.lit(0).alias("ref_id"), F.col("id").cast("int").alias("pos"), F.expr("array(named_struct('op', 'M', 'len', 60))").alias("cigar"))
    spans = spark.range(region.BROADCAST_INTERVALS + 1).select(F.col("id").alias("interval_id"), F.lit(0).alias("ref_id"), (F.col("id") * 50).alias("beg"), (F.col("id") * 50 + 100).alias("end"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    joined = region.bin_join(reads, spans)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
