"""SAM text of records, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.cigar import format_cigar


#: Each byte and its character, 33 further on; 223 has none.
_BYTES = [i for i in range(256) if i != 223]
_CODES, _PHRED = "".join(map(chr, _BYTES)), "".join(chr((i + 33) % 256) for i in _BYTES)


def phred_text(qual: Column) -> Column:
    """Qualities as characters; null prints '*'."""
    text = F.translate(F.decode(qual, "ISO-8859-1"), _CODES, _PHRED)
    return F.when(F.octet_length(qual) > 0, text).otherwise(F.lit("*"))


def star(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), F.lit("*")).otherwise(text)


def next_name() -> Column:
    """'=' where the mate has the record's reference."""
    same = (F.col("next_ref_id") >= 0) & (F.col("next_ref_id") == F.col("ref_id"))
    return F.when(same, F.lit("=")).otherwise(star(F.col("next_rname")))


def sam_line(tag_line: Column) -> Column:
    """The eleven fields and the tags' text (tab-separated, may be empty) of a record in reads columns."""
    fields = F.concat_ws(
        "\t",
        star(F.col("qname")),
        F.col("flag").cast("string"),
        star(F.col("rname")),
        F.greatest(F.col("pos") + 1, F.lit(0)).cast("string"),
        F.col("mapq").cast("string"),
        format_cigar(F.col("cigar")),
        next_name(),
        F.greatest(F.col("next_pos") + 1, F.lit(0)).cast("string"),
        F.col("tlen").cast("string"),
        star(F.col("seq")),
        phred_text(F.col("qual")),
    )
    return F.when(tag_line.isNull() | (tag_line == ""), fields).otherwise(F.concat(fields, F.lit("\t"), tag_line))
