"""Read names, read-group ids and the natural order of names."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def movie(name: Column) -> Column:
    """The part before the first slash."""
    return F.substring_index(name, "/", 1)


def hole_number(name: Column) -> Column:
    """The second field as an int; raises if it is none."""
    field = F.get(F.split(name, "/"), F.lit(1))
    return F.when(field.rlike(r"^-?[0-9]+$"), field.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no hole number in read name: "), name)).cast("int"))


def zmw_or_zero(name: Column) -> Column:
    return F.coalesce(F.get(F.split(name, "/"), F.lit(1)).try_cast("int"), F.lit(0))


def query_start(name: Column, tag: Column | None = None) -> Column:
    """The qs tag, else the start in the name's third field s_e, else 0."""
    found = F.regexp_extract(name, r"^[^/]*/[^/]*/([0-9]+)_[0-9]+", 1).try_cast("int")
    return F.coalesce(*([tag.cast("int")] if tag is not None else []), found, F.lit(0))


def query_end(name: Column, length: Column, tag: Column | None = None) -> Column:
    """The qe tag, else the end in the name's third field s_e, else the length of the sequence."""
    found = F.regexp_extract(name, r"^[^/]*/[^/]*/[0-9]+_([0-9]+)", 1).try_cast("int")
    return F.coalesce(*([tag.cast("int")] if tag is not None else []), found, length.cast("int"))


def read_group_base(rg: Column) -> Column:
    """The id without its barcode suffix."""
    return F.substring_index(rg, "/", 1)


def read_group_hash(movie_name: Column, read_type: Column, strand: Column | None = None) -> Column:
    """First eight hex digits of the MD5 of movie//type, with //fwd or //rev for stranded groups."""
    text = F.concat(movie_name, F.lit("//"), read_type)
    if strand is not None:
        text = F.when(strand.isNull(), text).otherwise(F.concat(text, F.lit("//"), strand))
    return F.substring(F.md5(text), 1, 8)


def read_group_hash_py(movie_name: str, read_type: str, strand: str | None = None, barcode: str | None = None) -> str:
    text = f"{movie_name}//{read_type}" + (f"//{strand}" if strand else "")
    return hashlib.md5(text.encode()).hexdigest()[:8] + (f"/{barcode}" if barcode else "")


def read_group_number(rg: Column) -> Column:
    """The base id read as an unsigned 32-bit hex number, wrapped to signed; 0 if it is none."""
    base = read_group_base(rg)
    value = F.conv(base, 16, 10).cast("bigint")
    return F.when(base.rlike("^[0-9a-fA-F]{1,8}$"), F.when(value >= 2**31, value - 2**32).otherwise(value)).otherwise(F.lit(0)).cast("int")


def read_group_number_py(rg: str) -> int:
    base = rg.partition("/")[0]
    if not base or len(base) > 8 or any(c not in "0123456789abcdefABCDEF" for c in base):
        return 0
    value = int(base, 16)
    return value - 2**32 if value >= 2**31 else value


def natural_key(name: Column) -> Column:
    """A string whose byte order is the natural order of names of up to 254 characters.

    A run of digits becomes '0', its number of digits without leading zeros in two hex digits, those
    digits, and its number of leading zeros in two hex digits; other characters stay.
    """

    def two(n: Column) -> Column:
        return F.lpad(F.hex(n.cast("bigint")), 2, "0")

    def encode(piece: Column) -> Column:
        digits = F.ltrim(piece, F.lit("0"))
        return F.when(
            F.substring(piece, 1, 1).between("0", "9"),
            F.concat(F.lit("0"), two(F.length(digits)), digits, two(F.length(piece) - F.length(digits))),
        ).otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), encode), "")


def natural_key_py(name: str) -> str:
    import re

    def encode(m):
        digits = m[0].lstrip("0")
        return f"0{len(digits):02X}{digits}{len(m[0]) - len(digits):02X}"

    return re.sub("[0-9]+", encode, name)
