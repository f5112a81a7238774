"""The tag map: selection, typed access, and SAM text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Per-base kinetics, which sub-sampling can leave out.
KINETICS = ("fi", "fp", "ri", "rp", "ip", "pw")


def drop_tags(tags: Column, keys: tuple[str, ...] | list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*keys)) if keys else tags


def keep_tags(tags: Column, keys: tuple[str, ...] | list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(*keys)) if keys else F.map_filter(tags, lambda k, _: F.lit(False))


def strip_kinetics(tags: Column) -> Column:
    return drop_tags(tags, KINETICS)


def int_tag(tags: Column, key: str) -> Column:
    return tags[key]["i"]


def text_tag(tags: Column, key: str) -> Column:
    return tags[key]["s"]


def barcodes(tags: Column) -> Column:
    """struct<fwd, rev> of tag bc (two 16-bit numbers; 65535 is -1); without the tag (-1, -1)."""
    pair = tags["bc"]["ai"]

    def one(i: int) -> Column:
        value = F.get(pair, F.lit(i))
        return F.coalesce(F.when(value == 65535, F.lit(-1)).otherwise(value), F.lit(-1)).cast("int")

    bad = pair.isNotNull() & ((F.size(pair) != 2) | (F.array_min(pair) < -1))
    return F.when(bad, F.raise_error(F.lit("tag bc must hold two barcodes")).cast("struct<fwd:int,rev:int>")).otherwise(F.struct(one(0).alias("fwd"), one(1).alias("rev")))


def with_int_tag(tags: Column, key: str, value: Column) -> Column:
    """tags with an integer tag set."""
    one = F.struct(
        F.lit("i").alias("t"),
        value.cast("bigint").alias("i"),
        F.lit(None).cast("float").alias("f"),
        F.lit(None).cast("string").alias("s"),
        F.lit(None).cast("string").alias("et"),
        F.lit(None).cast("array<bigint>").alias("ai"),
        F.lit(None).cast("array<float>").alias("af"),
    )
    return F.map_concat(F.map_filter(tags, lambda k, _: k != key), F.create_map(F.lit(key), one))


def required(tags: Column, key: str, field: str) -> Column:
    """A field of a tag that must be there."""
    value = tags[key][field]
    return F.when(value.isNull(), F.raise_error(F.lit(f"no tag {key}"))).otherwise(value)


def context_flags(tags: Column) -> Column:
    """cx, 0 without it."""
    return F.coalesce(int_tag(tags, "cx"), F.lit(0)).cast("int")


def signal_to_noise(tags: Column) -> Column:
    """sn, four floats in the order A, C, G, T; raises without it."""
    return required(tags, "sn", "af")


def read_quality(tags: Column) -> Column:
    """rq; raises without it."""
    return required(tags, "rq", "f")


def read_group(tags: Column) -> Column:
    """RG; raises without it."""
    return required(tags, "RG", "s")


def frames(tags: Column, key: str) -> Column:
    """Frame counts of ip or pw: 16-bit values as they are, 8-bit codes undecoded; null without the tag."""
    return tags[key]["ai"]


def movie_frames(tags: Column, key: str) -> Column:
    """ws or we, the first or last frame; null without the tag."""
    return int_tag(tags, key)
