"""CIGAR expressions: parsing, formatting, lengths, statistics and bins, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=X"
QUERY_OPS, REFERENCE_OPS, DEPTH_OPS = "MIS=X", "MDN=X", "MD=X"
MOST_LENGTH = 2**28 - 1
#: (shift, first bin) of the binning levels below the root, coarse to fine.
BIN_LEVELS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
BIN_END = 1 << 29


def _among(op: Column, ops: str) -> Column:
    return op.isin(*ops)


def parse_cigar(text: Column) -> Column:
    """array<struct<op, len>> of CIGAR text; '*' and '' are empty, anything else malformed raises.

    Zero lengths are allowed; a length beyond 2**28 - 1 raises.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(0))
    long_ = F.expr(f"{2**28}")
    ops = F.transform(
        pieces,
        lambda p: F.struct(
            F.right(p, F.lit(1)).alias("op"),
            F.when(F.substring(p, F.lit(1), F.length(p) - 1).cast("decimal(38,0)") < long_, F.substring(p, F.lit(1), F.length(p) - 1).cast("int"))
            .otherwise(F.raise_error(F.concat(F.lit("CIGAR length out of range: "), p)).cast("int"))
            .alias("len"),
        ),
    )
    empty = F.expr("cast(array() as array<struct<op:string,len:int>>)")
    return (
        F.when(text.isNull() | text.isin("", "*"), empty)
        .when(text.rlike(r"^([0-9]+[MIDNSHP=X])+$"), ops)
        .otherwise(F.raise_error(F.concat(F.lit("invalid CIGAR: "), text)).cast("array<struct<op:string,len:int>>"))
    )


def format_cigar(cigar: Column) -> Column:
    """CIGAR text of an op array; empty prints '*'."""
    text = F.array_join(F.transform(cigar, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return F.when(F.size(cigar) > 0, text).otherwise(F.lit("*"))


def length_of(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the given ops."""
    return F.aggregate(cigar, F.lit(0).cast("bigint"), lambda n, o: n + F.when(_among(o["op"], ops), o["len"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    return length_of(cigar, REFERENCE_OPS)


def query_length(cigar: Column) -> Column:
    return length_of(cigar, QUERY_OPS)


def mismatches(cigar: Column) -> Column:
    return length_of(cigar, "X")


def reference_end(pos: Column, cigar: Column) -> Column:
    return pos.cast("bigint") + reference_length(cigar)


def aligned_bounds(cigar: Column) -> Column:
    """struct<start, end>: query positions of the first and behind the last base that is not clipped."""
    soft = F.aggregate(
        cigar,
        F.struct(F.lit(0).cast("bigint").alias("lead"), F.lit(0).cast("bigint").alias("tail"), F.lit(False).alias("met"), F.lit(0).cast("bigint").alias("query")),
        lambda a, o: F.struct(
            (a["lead"] + F.when(~a["met"] & (o["op"] == "S"), o["len"]).otherwise(0)).alias("lead"),
            F.when(o["op"] == "S", a["tail"] + F.when(a["met"], o["len"]).otherwise(0)).when(o["op"] == "H", a["tail"]).otherwise(F.lit(0).cast("bigint")).alias("tail"),
            (a["met"] | ~o["op"].isin("S", "H")).alias("met"),
            (a["query"] + F.when(_among(o["op"], QUERY_OPS), o["len"]).otherwise(0)).alias("query"),
        ),
    )
    return F.transform(F.array(soft), lambda s: F.struct(s["lead"].alias("start"), (s["query"] - s["tail"]).alias("end")))[0]


def cigar_stats(cigar: Column) -> Column:
    """struct of counts: matches (M and =), mismatches, insertions, deletions, their events, aligned bases, span, identities in percent."""
    zero = F.lit(0).cast("bigint")
    names = ("matches", "mismatches", "insertions", "deletions", "insertion_events", "deletion_events")

    def step(a: Column, o: Column) -> Column:
        op, n = o["op"], o["len"].cast("bigint")
        gains = (
            F.when(op.isin("M", "="), n),
            F.when(op == "X", n),
            F.when(op == "I", n),
            F.when(op == "D", n),
            F.when(op == "I", F.lit(1)),
            F.when(op == "D", F.lit(1)),
        )
        return F.struct(*((a[k] + g.otherwise(0)).alias(k) for k, g in zip(names, gains, strict=True)))

    def finish(a: Column) -> Column:
        bases = a["matches"] + a["mismatches"]
        aligned = bases + a["insertions"]

        def percent(whole: Column) -> Column:
            return F.when(whole > 0, F.lit(100.0) * a["matches"] / whole).otherwise(F.lit(0.0))

        return F.struct(
            *(a[k].alias(k) for k in names),
            aligned.alias("aligned_bases"),
            aligned.alias("span"),
            percent(aligned + a["deletions"]).alias("identity"),
            percent(bases + a["insertion_events"] + a["deletion_events"]).alias("gap_compressed_identity"),
        )

    return F.aggregate(cigar, F.struct(*(zero.alias(k) for k in names)), step, finish)


def spans(pos: Column, cigar: Column, ops: str = DEPTH_OPS) -> Column:
    """array<struct<beg, end>>: the reference intervals that the given ops cover, neighbours merged.

    Without an operation that passes over the reference uncovered, which is the common case, that is one
    interval as long as the covering operations.
    """
    none = F.expr("cast(array() as array<struct<beg:bigint,end:bigint>>)")
    passing = "".join(o for o in REFERENCE_OPS if o not in ops)
    start = pos.cast("bigint")
    whole = length_of(cigar, ops)
    single = F.when(whole > 0, F.array(F.struct(start.alias("beg"), (start + whole).alias("end")))).otherwise(none)

    def step(a: Column, o: Column) -> Column:
        to = a["at"] + F.when(_among(o["op"], REFERENCE_OPS), o["len"]).otherwise(0)
        piece = F.struct(a["at"].alias("beg"), to.alias("end"))
        last = F.element_at(a["out"], -1)
        joined = F.concat(
            F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1),
            F.array(F.struct(last["beg"].alias("beg"), to.alias("end"))),
        )
        touching = (F.size(a["out"]) > 0) & (F.try_element_at(a["out"], F.lit(-1))["end"] == a["at"])
        out = F.when(~_among(o["op"], ops) | (o["len"] == 0), a["out"]).when(touching, joined).otherwise(F.concat(a["out"], F.array(piece)))
        return F.struct(to.alias("at"), out.alias("out"))

    several = F.aggregate(cigar, F.struct(start.alias("at"), none.alias("out")), step, lambda a: a["out"])
    if not passing:
        return single
    return F.when(F.exists(cigar, lambda o: _among(o["op"], passing)), several).otherwise(single)


def op_positions(pos: Column, cigar: Column) -> Column:
    """array<struct<op, len, ref_beg, query_beg>>: where each op begins."""
    start = F.struct(
        pos.cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("q"), F.expr("cast(array() as array<struct<op:string,len:int,ref_beg:bigint,query_beg:bigint>>)").alias("out")
    )
    return F.aggregate(
        cigar,
        start,
        lambda a, o: F.struct(
            (a["r"] + F.when(_among(o["op"], REFERENCE_OPS), o["len"]).otherwise(0)).alias("r"),
            (a["q"] + F.when(_among(o["op"], QUERY_OPS), o["len"]).otherwise(0)).alias("q"),
            F.concat(a["out"], F.array(F.struct(o["op"].alias("op"), o["len"].alias("len"), a["r"].alias("ref_beg"), a["q"].alias("query_beg")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def reg2bin(beg: Column, end: Column) -> Column:
    """The smallest bin that holds [beg, end); beg -1, end 0 gives 4680."""
    beg, last = beg.cast("bigint"), end.cast("bigint") - 1
    out = None
    for shift, first in reversed(BIN_LEVELS):
        same = F.shiftright(beg, shift) == F.shiftright(last, shift)
        value = F.shiftright(beg, shift) + first
        out = F.when(same, value) if out is None else out.when(same, value)
    return out.otherwise(F.lit(0)).cast("int")


def reg2bins(beg: Column, end: Column) -> Column:
    """array of all bins that may hold records overlapping [beg, end); the end is clamped to 2**29."""
    beg = beg.cast("bigint")
    last = F.least(end.cast("bigint"), F.lit(BIN_END).cast("bigint")) - 1
    levels = [F.sequence(F.shiftright(beg, s) + f, F.shiftright(last, s) + f) for s, f in BIN_LEVELS]
    return F.when(beg <= last, F.transform(F.concat(F.array(F.lit(0).cast("bigint")), *levels), lambda b: b.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def bins_of(beg: int, end: int) -> list[int]:
    """reg2bins on the driver."""
    end = min(end, BIN_END)
    if beg >= end:
        return []
    return [0, *(b for shift, first in BIN_LEVELS for b in range(first + (beg >> shift), first + ((end - 1) >> shift) + 1))]


def bin_of(beg: int, end: int) -> int:
    """reg2bin on the driver."""
    last = end - 1
    for shift, first in reversed(BIN_LEVELS):
        if beg >> shift == last >> shift:
            return first + (beg >> shift)
    return 0
