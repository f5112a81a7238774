"""Binned coverage depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.functions.cigar import spans

BIN_SIZE = 1000


def counted(reads: DataFrame) -> DataFrame:
    """Records that add to the depth: placed, and neither unmapped, secondary, failed nor duplicate."""
    return reads.where((F.col("flag").bitwiseAND(S.DEPTH_EXCLUDED) == 0) & (F.col("ref_id") >= 0))


def binned_depth(reads: DataFrame, refs: DataFrame, bin_size: int = BIN_SIZE) -> DataFrame:
    """ref_id, contig, start, end, depth_bases, mean_depth of each bin of each contig, empty ones too.

    refs is the header's dimension; it is broadcast only if Spark's own size limit allows. A record's
    spans are cut to its bins in the map stage, so partial sums leave one row per bin and task; the
    bases that it has within a bin are an integer, and the mean is theirs over the bin's length.
    """
    lengths = refs.select("ref_id", F.col("length").alias("ref_length"))
    placed = counted(reads).select("ref_id", F.explode(spans(F.col("pos"), F.col("cigar"))).alias("s"))
    cut = placed.join(lengths, "ref_id").select("ref_id", F.greatest(F.col("s.beg"), F.lit(0)).alias("beg"), F.least(F.col("s.end"), F.col("ref_length")).alias("end")).where("beg < end")
    pieces = cut.select("ref_id", "beg", "end", F.explode(F.expr(f"sequence(beg div {bin_size}, (end - 1) div {bin_size})")).alias("bin"))
    bases = F.least(F.col("end"), (F.col("bin") + 1) * bin_size) - F.greatest(F.col("beg"), F.col("bin") * bin_size)
    sums = pieces.groupBy("ref_id", "bin").agg(F.sum(bases).alias("bases"))
    grid = refs.where("length > 0").select("ref_id", F.col("name").alias("contig"), "length", F.explode(F.expr(f"sequence(0L, (length - 1L) div {bin_size})")).alias("bin"))
    total = F.coalesce(F.col("bases"), F.lit(0)).cast("bigint")
    start, end = F.col("bin") * bin_size, F.least((F.col("bin") + 1) * bin_size, F.col("length").cast("bigint"))
    return grid.join(sums, ["ref_id", "bin"], "left").select(
        "ref_id", "contig", start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), total.alias("depth_bases"), (total / (end - start)).alias("mean_depth")
    )


def depth_totals(reads: DataFrame, refs: DataFrame, bin_size: int = BIN_SIZE) -> DataFrame:
    """records, counted_records, depth_bases, bins, bin_size: one row."""
    lengths = refs.select("ref_id", F.col("length").alias("ref_length"))
    inside = F.aggregate(
        spans(F.col("pos"), F.col("cigar")),
        F.lit(0).cast("bigint"),
        lambda n, s: n + F.greatest(F.least(s["end"], F.col("ref_length")) - F.greatest(s["beg"], F.lit(0)), F.lit(0)),
    )
    counts = (F.col("flag").bitwiseAND(S.DEPTH_EXCLUDED) == 0) & (F.col("ref_id") >= 0)
    sums = reads.join(lengths, "ref_id", "left").agg(
        F.count("*").alias("records"), F.count_if(counts).alias("counted_records"), F.coalesce(F.sum(F.when(counts & F.col("ref_length").isNotNull(), inside)), F.lit(0)).cast("bigint").alias("depth_bases")
    )
    bins = refs.agg(F.sum(F.expr(f"(length + {bin_size - 1}) div {bin_size}")).alias("bins")).first()["bins"] or 0
    return sums.withColumns({"bins": F.lit(bins).cast("bigint"), "bin_size": F.lit(bin_size).cast("bigint")})
