"""Index builders: offsets, coalesced ranges, BAI bins, linear index and counts, CRAI spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions.cigar import BIN_END, reference_end, reg2bin
from readloom.functions.ordinals import with_neighbour
from readloom.functions.storage import materialize

WINDOW_SHIFT = 14
METADATA_BIN = 37450
#: Virtual offsets of 64 MB of file: a deep bin is coalesced in stretches of it.
STRETCH = 64 << 20 << 16


def with_end_offset(reads: DataFrame, last_end: int) -> DataFrame:
    """reads with end_voffset: where the next record of the file begins, for its last record last_end.

    rec_no is dense, so the next record is found within ranges of record numbers.
    """
    keys = [c for c in ("file_ord",) if c in reads.columns]
    return with_neighbour(reads, "rec_no", 1, F.col("voffset"), "_after", keys).withColumn("end_voffset", F.coalesce("_after", F.lit(last_end))).drop("_after")


def coalesce_ranges(ranges: DataFrame, keys: list[str], span: int | None = None) -> DataFrame:
    """beg, end ranges of each key with those joined whose begin does not lie behind the end before it.

    With span, ranges are joined within stretches of that many positions first, so that a key with very many
    ranges is spread over tasks and reaches the last step as a few.
    """
    if span is not None:
        stretched = ranges.withColumn("_stretch", F.expr(f"beg div {span}"))
        ranges = coalesce_ranges(stretched, [*keys, "_stretch"]).drop("_stretch")
    order = Window.partitionBy(*keys).orderBy("beg", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(F.col("beg") <= reach, 0).otherwise(1))
    grouped = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*keys, "_run").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("_run")


def mapped_spans(reads: DataFrame) -> DataFrame:
    """Placed, mapped records with the end of their alignment (one base at least); raises outside of [0, 2**29)."""
    end = reference_end(F.col("pos"), F.col("cigar"))
    ok = (F.col("pos") >= 0) & (end <= BIN_END)
    placed = (F.col("ref_id") >= 0) & (F.col("flag").bitwiseAND(4) == 0)
    # The condition is repeated inside, since the optimizer may compute ref_end before it filters.
    checked = F.when(placed & ~ok, F.raise_error(F.lit("a mapped record lies outside of [0, 2**29)")).cast("bigint")).otherwise(F.greatest(end, F.col("pos").cast("bigint") + 1))
    return reads.where(placed).withColumn("ref_end", checked)


def bai_bins(reads: DataFrame) -> DataFrame:
    """ref_id, bin, beg, end: coalesced file ranges of the records of each bin."""
    rows = mapped_spans(reads).select("ref_id", reg2bin(F.col("pos"), F.col("ref_end")).alias("bin"), F.col("voffset").alias("beg"), F.col("end_voffset").alias("end"))
    return coalesce_ranges(rows, ["ref_id", "bin"], STRETCH)


def bai_linear(reads: DataFrame) -> DataFrame:
    """ref_id, win, voffset: the least offset of a record that meets each 16 KiB window."""
    rows = mapped_spans(reads).select("ref_id", "voffset", F.explode(F.sequence(F.shiftright("pos", WINDOW_SHIFT), F.shiftright(F.col("ref_end") - 1, WINDOW_SHIFT).cast("int"))).alias("win"))
    return rows.groupBy("ref_id", "win").agg(F.min("voffset").alias("voffset"))


def bai_meta(reads: DataFrame) -> DataFrame:
    """ref_id, beg, end, n_mapped, n_unmapped of the placed records of each reference."""
    return (
        reads.where("ref_id >= 0")
        .groupBy("ref_id")
        .agg(
            F.min("voffset").alias("beg"),
            F.max("end_voffset").alias("end"),
            F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("n_mapped"),
            F.count_if(F.col("flag").bitwiseAND(4) != 0).alias("n_unmapped"),
        )
    )


def no_coordinate_count(reads: DataFrame) -> DataFrame:
    return reads.where("ref_id < 0").agg(F.count("*").alias("n_no_coor"))


def slice_spans(reads: DataFrame, slice_column: str = "slice") -> DataFrame:
    """slice, ref_id, start (1-based, 0 for unplaced), span and n_records of each slice and reference."""
    end = F.greatest(reference_end(F.col("pos"), F.col("cigar")), F.col("pos").cast("bigint") + 1)
    rows = reads.withColumn("_end", end)
    low, placed = F.min("pos"), F.col("ref_id") >= 0
    return rows.groupBy(slice_column, "ref_id").agg(
        F.when(F.first(placed), low + 1).otherwise(0).cast("bigint").alias("start"),
        F.when(F.first(placed), F.max("_end") - low).otherwise(0).cast("bigint").alias("span"),
        F.count("*").alias("n_records"),
    )


def resolve_mates(reads: DataFrame) -> DataFrame:
    """reads of one slice order (slice, ord) with nf >= 0 joined with their mate nf + 1 records on.

    Both get the other's reference and position, and the template length: from the leftmost to the
    rightmost base, positive for the record further left (for the first at equal positions), 0 on
    different references.
    """
    # Few columns, stored, since both sides of the join read them.
    own = materialize(reads.select("slice", "ord", "rec_no", "ref_id", "pos", "nf", reference_end(F.col("pos"), F.col("cigar")).alias("_end")))
    first = own.where("nf >= 0").withColumn("_mate", F.col("ord") + F.col("nf") + 1)
    mate = own.select("slice", F.col("ord").alias("_mate"), F.col("rec_no").alias("m_rec"), F.col("ref_id").alias("m_ref"), F.col("pos").alias("m_pos"), F.col("_end").alias("m_end"))
    pairs = first.join(mate, ["slice", "_mate"])
    span = F.greatest("_end", "m_end") - F.least("pos", "m_pos")
    size = F.when((F.col("ref_id") == F.col("m_ref")) & (F.col("ref_id") >= 0), span).otherwise(0)
    signed = F.when(F.col("pos") <= F.col("m_pos"), size).otherwise(-size)
    both = F.array(
        F.struct(F.col("rec_no").alias("rec_no"), F.col("m_ref").alias("next_ref_id"), F.col("m_pos").alias("next_pos"), signed.cast("bigint").alias("tlen")),
        F.struct(F.col("m_rec").alias("rec_no"), F.col("ref_id").alias("next_ref_id"), F.col("pos").alias("next_pos"), (-signed).cast("bigint").alias("tlen")),
    )
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def positional_mismatch(records: DataFrame, index: DataFrame) -> DataFrame:
    """first_bad: the least rec_no at which records and index differ in identity or length, or one has no row; null if none."""
    left = records.select("rec_no", F.struct("rg_id", "zmw", "qlen").alias("a"))
    right = index.select("rec_no", F.struct("rg_id", "zmw", "qlen").alias("b"))
    return left.join(right, "rec_no", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min("rec_no").alias("first_bad"))
