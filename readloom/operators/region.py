"""Region queries: parsing, overlap filters, index pruning and the bin join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.functions.cigar import BIN_LEVELS, bins_of, reference_end

#: Least and greatest shift of the finest cells of bin_join.
BIN_SHIFTS = (7, 14)
#: Intervals up to which bin_join broadcasts them; each is listed about ten times.
BROADCAST_INTERVALS = 10_000


@dataclass(frozen=True)
class Region:
    """name is None for the unplaced reads ('*'); beg and end are 0-based, half-open."""

    name: str | None
    beg: int = 0
    end: int = S.INT_MAX


def parse_region(text: str) -> Region:
    """'*', 'ref', 'ref:start', 'ref:start-end': 1-based, inclusive, split at the last colon; start 0 means 1."""
    if text == "*":
        return Region(None)
    name, colon, range_ = text.rpartition(":")
    if not colon:
        if not text:
            raise ValueError("empty region")
        return Region(text)
    first, dash, last = range_.partition("-")
    if not name or not first.isdecimal() or (dash and not last.isdecimal()):
        raise ValueError(f"invalid region: {text}")
    beg = max(int(first), 1) - 1
    end = int(last) if dash else S.INT_MAX
    if end <= beg or end > S.INT_MAX:
        raise ValueError(f"invalid region: {text}")
    return Region(name, beg, end)


def overlaps(ref_id: int, beg: int, end: int) -> Column:
    """Strict overlap with [beg, end); the plain comparisons on ref_id and pos reach the scan."""
    return (F.col("ref_id") == ref_id) & (F.col("pos") < end) & (reference_end(F.col("pos"), F.col("cigar")) > beg)


def overlaps_nonempty(ref_id: int, beg: int, end: int) -> Column:
    """As overlaps, where an alignment of no length takes up one base."""
    last = F.greatest(reference_end(F.col("pos"), F.col("cigar")), F.col("pos").cast("bigint") + 1)
    return (F.col("ref_id") == ref_id) & (F.col("pos") < end) & (last > beg)


def unplaced() -> Column:
    return F.col("ref_id") < 0


def query_region(reads: DataFrame, refs: DataFrame, region: Region, nonempty: bool = False) -> DataFrame:
    """Reads of a region; an unknown reference gives none. One row of refs is looked up on the driver."""
    if region.name is None:
        return reads.where(unplaced())
    found = refs.where(F.col("name") == region.name).select("ref_id").take(1)
    if not found:
        return reads.limit(0)
    return reads.where((overlaps_nonempty if nonempty else overlaps)(found[0]["ref_id"], region.beg, region.end))


def _level(beg: Column, end: Column, shifts: list[int]) -> Column:
    """The smallest of the shifts whose cells are as long as [beg, end)."""
    out = F.lit(shifts[-1])
    for shift in reversed(shifts[:-1]):
        out = F.when(end - beg <= F.lit(1 << shift).cast("bigint"), F.lit(shift)).otherwise(out)
    return out


def _cells(beg: str, end: str, own: str, higher: list[int]) -> Column:
    """array of the bins of [beg, end): on its own level and on the given ones above it, two each, null where there is one."""
    out = []
    for shift in (own, *higher):
        first, last = f"shiftright({beg}, {shift})", f"shiftright({end} - 1, {shift})"
        there = "true" if shift == own else f"{own} < {shift}"
        out += [f"if({there}, {first} * 64 + {shift}, null)", f"if({there} and {last} > {first}, {last} * 64 + {shift}, null)"]
    return F.expr(f"array({', '.join(out)})")


def bin_join(reads: DataFrame, intervals: DataFrame) -> DataFrame:
    """Reads joined with every interval (interval_id, ref_id, beg, end) that they overlap; empty intervals have none.

    Both sides list bins: cells of a few levels, of which the finest is about twice as wide as the mean interval. A
    row's own level is the first whose cells are as long as itself, so it touches two of them at most. A pair meets on the
    higher of its two levels, in the cell where the later of both begins: intervals list their own and all higher levels,
    reads their own and those higher ones that intervals have. The join is an equi-join on (ref_id, bin). Intervals
    are counted: few are broadcast, beyond BROADCAST_INTERVALS both sides are shuffled.
    """
    spans = intervals.where("end > beg").select("interval_id", "ref_id", F.col("beg").cast("bigint").alias("i_beg"), F.col("end").cast("bigint").alias("i_end"))
    seen = spans.agg(F.count("*").alias("n"), F.avg(F.col("i_end") - F.col("i_beg")).alias("mean")).first()
    finest = min(max(int(seen["mean"] or 0).bit_length() + 1, BIN_SHIFTS[0]), BIN_SHIFTS[1])
    shifts = [*range(finest, 32, 3), 62]
    own = _level(F.col("i_beg"), F.col("i_end"), shifts)
    met = sorted(r[0] for r in spans.select(own).distinct().collect())  # a dozen levels at most
    right = spans.withColumn("_i_own", own).withColumn("bin", F.explode(_cells("i_beg", "i_end", "_i_own", shifts[1:])))
    right = F.broadcast(right) if seen["n"] <= BROADCAST_INTERVALS else right.hint("merge")

    beg = F.col("pos").cast("bigint")
    end = F.coalesce(F.greatest(reference_end(F.col("pos"), F.col("cigar")), beg + 1), F.lit(0).cast("bigint"))  # never null, so that no filter computes it again
    left = reads.where("ref_id >= 0").withColumn("ref_end", end).withColumn("_own", _level(beg, F.col("ref_end"), shifts))
    left = left.withColumn("bin", F.explode(_cells("cast(pos as bigint)", "ref_end", "_own", [s for s in met if s > finest])))
    overlap = (F.col("pos") < F.col("i_end")) & (F.col("ref_end") > F.col("i_beg"))
    once = F.expr("(bin & 63) = greatest(_own, _i_own) and shiftright(bin, 6) = shiftright(greatest(cast(pos as bigint), i_beg), cast(bin & 63 as int))")
    return left.join(right, ["ref_id", "bin"]).where(overlap & once).drop("bin", "_own", "_i_own")


def index_chunks(bins: DataFrame, linear: DataFrame, ref_id: int, beg: int, end: int) -> DataFrame:
    """beg, end of the file ranges that a BAI (ref_id, bin, beg, end; ref_id, win, voffset) gives for a region.

    Ranges that end before the first read of the region's 16 KiB window are dropped (past the last
    window that one counts), and the rest is merged.
    """
    from readloom.operators.index import coalesce_ranges

    wanted = bins.where((F.col("ref_id") == ref_id) & F.col("bin").isin(bins_of(max(beg, 0), end)))
    window = max(beg, 0) >> BIN_LEVELS[-1][0]
    least = linear.where((F.col("ref_id") == ref_id) & (F.col("win") <= window)).agg(F.max_by("voffset", "win").alias("least")).first()["least"]
    kept = wanted.where(F.col("end") > (least or 0)).select("ref_id", "beg", "end")
    return coalesce_ranges(kept, ["ref_id"]).select("beg", "end")


def crai_slices(crai: DataFrame, ref_id: int, beg: int, end: int) -> DataFrame:
    """Slices (container, slice, size) of a CRAI that meet [beg, end), each once, in order."""
    first = F.col("start") - 1
    meets = (F.col("seq_id") == ref_id) & (first < end) & (first + F.greatest(F.col("span"), F.lit(1)) > beg)
    return crai.where(meets).select("container", "slice", "size").distinct().orderBy("container", "slice", "size")
