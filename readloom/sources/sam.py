"""SAM text: a native, splittable scan and a sink."""

from __future__ import annotations

import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from readloom import schema as S
from readloom.functions.cigar import parse_cigar, query_length
from readloom.functions.sam_text import sam_line
from readloom.header import Header, parse_header
from readloom.sources import parts
from readloom.sources.columns import array_of, values_of
from readloom.sources.records import parse_tag, tags_text


def read_header(path: str) -> Header:
    """The header lines at the head of a file."""
    lines = []
    with open(path.removeprefix("file://"), encoding="latin-1") as f:
        for line in f:
            if not line.startswith("@"):
                break
            lines.append(line.rstrip("\r\n") + "\n")
    return parse_header("".join(lines))


def _tag_maps(lines: pa.Array) -> pa.Array:
    """Tag maps; null where a tag is malformed. Of a repeated tag the last one counts."""
    from readloom.sources.bam import ARROW

    def parse(line: str):
        try:
            return dict(parse_tag(t) for t in line.split("\t")) if line else {}
        except ValueError:
            return None

    return array_of([parse(x) for x in lines.to_pylist()], ARROW.field("tags").type)


def _qualities(texts: pa.Array) -> pa.Array:
    """Codes of quality characters, 33 below them; the bytes of all texts are moved at once."""
    codes = texts.cast(pa.binary())
    valid, ends, data = codes.buffers()
    if data is None or not len(codes):
        return codes
    moved = np.frombuffer(data, dtype=np.uint8) - np.uint8(33)
    return pa.Array.from_buffers(pa.binary(), len(codes), [valid, ends, pa.py_buffer(moved.tobytes())], offset=codes.offset)


def parse_lines(lines: DataFrame, header: Header, mode: str = "FAILFAST") -> DataFrame:
    """Reads of SAM record lines (column value, and seq_no giving their order).

    A malformed line raises in mode FAILFAST and is left out in mode DROPMALFORMED. It has under eleven
    fields, or an invalid name, number, CIGAR, quality or tag, or names an unknown reference, or its CIGAR,
    sequence and qualities differ in length.
    """
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError(f"unknown mode: {mode}")
    fields = [F.get(F.col("_f"), F.lit(i)) for i in range(11)]
    names = {r.key: i for i, r in enumerate(header.references)}
    ref_map = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.expr("cast(map() as map<string,int>)")
    rnext = F.when(fields[6] == "=", fields[2]).otherwise(fields[6])
    cigar_ok = fields[5].rlike(r"^(\*|([0-9]{1,9}[MIDNSHP=X])+)$")
    cigar = parse_cigar(F.when(cigar_ok, fields[5]).otherwise(F.lit("*")))
    bare = fields[9] == "*"
    faults: list[tuple[str, Column]] = [("a SAM line has eleven fields", F.size("_f") >= 11), ("invalid read name", fields[0].rlike("^(\\*|[!-?A-~]{1,254})$"))]

    def number(i: int, what: str, low: int, high: int) -> Column:
        value = fields[i].try_cast("bigint")
        faults.append((f"invalid {what}", value.between(low, high)))
        return value

    def ref(name: Column) -> Column:
        found = F.when(name == "*", F.lit(-1)).otherwise(F.try_element_at(ref_map, name))
        faults.append(("unknown reference", found.isNotNull()))
        return found

    columns = {
        "file_ord": F.lit(0),
        "rec_no": F.col("seq_no"),
        "voffset": F.col("seq_no"),
        "qname": F.when(fields[0] == "*", "").otherwise(fields[0]),
        "flag": number(1, "flag", 0, 65535).cast("int"),
        "ref_id": ref(fields[2]).cast("int"),
        "rname": fields[2],
        "pos": (number(3, "position", 0, S.INT_MAX) - 1).cast("int"),
        "mapq": number(4, "mapping quality", 0, 255).cast("smallint"),
        "cigar": cigar,
        "next_ref_id": ref(rnext).cast("int"),
        "next_rname": rnext,
        "next_pos": (number(7, "mate position", 0, S.INT_MAX) - 1).cast("int"),
        "tlen": number(8, "template length", -S.INT_MAX, S.INT_MAX).cast("int"),
        "seq": F.when(bare, "").otherwise(fields[9]),
        "qual": F.when(fields[10] != "*", F.arrow_udf(_qualities, BinaryType())(fields[10])),
    }
    faults += [
        ("invalid CIGAR", cigar_ok & F.forall(cigar, lambda o: o["len"] < 2**28)),
        ("CIGAR and sequence differ in length", bare | (fields[5] == "*") | (query_length(cigar) == F.length(fields[9]))),
        ("invalid qualities", (fields[10] == "*") | (fields[10].rlike(r"^[!-~]+$") & (F.length(fields[10]) == F.length(fields[9])))),
    ]
    sound = F.lit(None).cast("string")
    for what, ok in reversed(faults):
        sound = F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)).otherwise(sound)
    tags = F.arrow_udf(_tag_maps, S.READS["tags"].dataType)(F.array_join(F.slice(F.col("_f"), F.lit(12), F.greatest(F.size("_f") - 11, F.lit(0))), "\t"))
    rows = lines.withColumn("_f", F.split("value", "\t")).withColumn("_fault", sound)
    if mode == "FAILFAST":
        rows = rows.where(F.col("_fault").isNull() | F.raise_error(F.concat(F.col("_fault"), F.lit(": "), F.col("value"))).cast("boolean"))
    else:
        rows = rows.where(F.col("_fault").isNull())
    out = rows.select("value", *(c.alias(n) for n, c in columns.items()), tags.alias("tags"))
    known = F.col("tags").isNotNull()
    if mode == "FAILFAST":
        known = known | F.raise_error(F.concat(F.lit("invalid tag: "), F.col("value"))).cast("boolean")
    return out.where(known).drop("value")


def read_sam(spark: SparkSession, path: str, header: Header | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Reads of a SAM file; rec_no and voffset follow the order of lines (they grow, but are not dense)."""
    header = header or read_header(path)
    lines = spark.read.text(path).withColumn("seq_no", F.monotonically_increasing_id()).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    return parse_lines(lines, header, mode)


def _tag_lines(tags: pa.Array) -> pa.Array:
    return pa.array([tags_text(t) for t in values_of(tags)], pa.string())


def sam_lines(reads: DataFrame) -> DataFrame:
    """line of each read (with its order columns); tags print in key order, floats as %g."""
    tag_line = F.arrow_udf(_tag_lines, StringType())(F.col("tags"))
    return reads.withColumn("_tags", tag_line).withColumn("line", sam_line(F.col("_tags"))).drop("_tags")


def write_sam(reads: DataFrame, path: str, header: Header) -> None:
    """One SAM file: parts are written by the tasks and joined behind the header in partition order."""
    work = f"{path}.parts-{uuid.uuid4().hex}"
    sam_lines(reads).select("line").write.text(work)
    names = sorted(n for n in os.listdir(work) if n.startswith("part-"))
    parts.join(reads.sparkSession, path, [parts.Piece(header.to_text().encode()), *(parts.whole(f"{work}/{n}") for n in names)])
    shutil.rmtree(work)
