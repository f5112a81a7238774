"""Sort orders, merging and concatenation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from readloom.functions.flags import is_reverse
from readloom.functions.names import natural_key
from readloom.functions.ordinals import sorted_by, with_neighbour

ORIGIN = ["file_ord", "rec_no"]


def origin(reads: DataFrame) -> list[Column]:
    """Ties keep input order: the file's number, then the record's."""
    return [F.col(c) for c in ORIGIN if c in reads.columns]


def coordinate_keys() -> list[Column]:
    """Reference (unplaced last), position, forward before reverse strand."""
    return [F.when(F.col("ref_id") < 0, F.lit(2**31 - 1)).otherwise(F.col("ref_id")), F.col("pos"), is_reverse(F.col("flag"))]


def sort_coordinate(reads: DataFrame) -> DataFrame:
    return sorted_by(reads, [*coordinate_keys(), *origin(reads)])


def queryname_keys() -> list[Column]:
    return [natural_key(F.col("qname")), F.col("flag").bitwiseAND(0xC0)]


def sort_queryname(reads: DataFrame) -> DataFrame:
    return sorted_by(reads, [*queryname_keys(), *origin(reads)])


def tag_keys(number: Column | None = None, text: Column | None = None) -> list[Column]:
    """Missing first, then numbers by value and texts by bytes, then coordinate order.

    A number and a text do not compare; here numbers come before texts, so that the order is total.
    """
    values = [c for c in (number, text) if c is not None]
    present = reduce(lambda a, b: a | b, [c.isNotNull() for c in values])
    return [present, *[x for c in values for x in (c.isNull(), c)], *coordinate_keys()]


def sort_tag(reads: DataFrame, number: Column | None = None, text: Column | None = None) -> DataFrame:
    return sorted_by(reads, [*tag_keys(number, text), *origin(reads)])


def tag_columns(key: str) -> tuple[Column, Column]:
    """Number and text of a tag in the tags map, for tag_keys; H and B count as neither."""
    tag = F.col("tags")[key]
    return F.coalesce(tag["i"].cast("double"), tag["f"].cast("double")), F.when(tag["t"].isin("A", "Z"), tag["s"])


# Fixed values of the minimiser: k-mer length, its mask, and the number that hashes are XORed with.
KMER, MASK, FLIP = 20, (1 << 40) - 1, 0xDEAD7878BEEF7878
_CODES = np.zeros(256, dtype=np.uint64)
_CODES[[ord("C"), ord("G"), ord("T")]] = [1, 2, 3]


def minimiser(seq: str | None) -> tuple[int, int]:
    """(hash, place) of the smallest 20-mer of the forward strand; earlier places have larger numbers."""
    codes = _CODES[np.frombuffer((seq or "").encode(), dtype=np.uint8)]
    n = len(codes) - KMER + 1
    if n <= 0:
        return (1 << 30) - 1, 65535 + KMER - 1
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(KMER):
        hashes = hashes << np.uint64(2) | codes[k : k + n]
    hashes = (hashes ^ np.uint64(FLIP & MASK)) & np.uint64(MASK)
    at = int(hashes.argmin())
    return int(hashes[at]) + (1 << 30), max(65535 - at, 0)


def _minimisers(seq: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([minimiser(s) for s in seq], columns=["hash", "place"])


def minimiser_key(seq: Column) -> Column:
    """struct<hash, place> of a sequence, in Arrow batches."""
    return pandas_udf(_minimisers, T.StructType([T.StructField("hash", T.LongType()), T.StructField("place", T.IntegerType())]))(seq)


def sort_minimiser(reads: DataFrame) -> DataFrame:
    """Coordinate order, where unplaced reads are clustered by minimiser."""
    free = F.col("ref_id") < 0
    keyed = reads.withColumn("_key", F.when(free, minimiser_key(F.col("seq"))))
    keys = [F.when(free, F.lit(2**31 - 1)).otherwise(F.col("ref_id")), F.col("_key.hash"), -F.col("_key.place"), F.col("pos"), is_reverse(F.col("flag"))]
    return sorted_by(keyed, [*keys, *origin(reads)]).drop("_key")


def numbered_inputs(inputs: list[DataFrame]) -> DataFrame:
    """UNION ALL of the inputs with file_ord, their number in the list."""
    parts = [df.withColumn("file_ord", F.lit(i)) for i, df in enumerate(inputs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def concat(inputs: list[DataFrame]) -> DataFrame:
    """Records of the inputs, input after input; no exchange. Their order is (file_ord, rec_no)."""
    return numbered_inputs(inputs)


def merge(inputs: list[DataFrame], order: str = "coordinate", number: Column | None = None, text: Column | None = None) -> DataFrame:
    """Sorted inputs as one sorted relation; ties by input, then by record.

    Inputs that are sorted need no less than one range exchange, which balances them as well.
    """
    rows = numbered_inputs(inputs)
    keys = {"coordinate": coordinate_keys, "queryname": queryname_keys}.get(order)
    if keys is None and order != "tag":
        raise ValueError(f"unknown order: {order}")
    return sorted_by(rows, [*(keys() if keys else tag_keys(number, text)), *origin(rows)])


def chain(inputs: list[DataFrame]) -> list[int] | None:
    """The order in which inputs, each sorted by coordinate, follow each other without overlap, or None if there is none.

    One narrow pass per input for its least and largest key; as many rows as inputs come back. Where an input ends with
    the key that the next begins with, ties go by input. Empty inputs come last.
    """
    bounds = []
    for i, reads in enumerate(inputs):
        key = F.struct(*(k.cast("int").alias(f"k{n}") for n, k in enumerate(coordinate_keys())))
        r = reads.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        bounds.append((tuple(r["low"]), tuple(r["high"]), i) if r["low"] is not None else None)
    found = sorted(b for b in bounds if b)
    for (_, high, i), (low, _, j) in zip(found, found[1:], strict=False):
        if high > low or (high == low and i > j):
            return None
    return [i for _, _, i in found] + [i for i, b in enumerate(bounds) if b is None]


def merge_chain(inputs: list[DataFrame]) -> DataFrame | None:
    """Inputs that are a chain as one sorted relation without an exchange, else None.

    Each input's partitions must hold its records in file order, as those of a file read with read_bam do; the order
    of the result is that of its partitions, so it is to be written or numbered as it is.
    """
    order = chain(inputs)
    return None if order is None else reduce(lambda a, b: a.unionByName(b), [inputs[i].withColumn("file_ord", F.lit(i)) for i in order])


def merge_mode(orders: list[str], concat_requested: bool = False) -> str:
    """'coordinate', 'queryname' or 'concat' from the inputs' header orders; mixed orders raise."""
    if not orders:
        raise ValueError("merge needs an input")
    kinds = {o if o in ("coordinate", "queryname") else "unsorted" for o in orders}
    if concat_requested or kinds == {"unsorted"}:
        return "concat"
    if len(kinds) > 1:
        raise ValueError(f"inputs have different sort orders: {', '.join(sorted(kinds))}")
    return kinds.pop()


def check_merge_order(orders: list[str], wanted: str) -> None:
    """Every input's header order must be the wanted one; tag order has no header and isn't checked."""
    for i, order in enumerate(orders):
        if wanted != "tag" and order != wanted:
            raise ValueError(f"input {i} is sorted by {order or 'nothing'}, not by {wanted}")


def disorder(reads: DataFrame) -> DataFrame:
    """n_records and n_out_of_order (records before their predecessor in file order): one row.

    Each record meets its predecessor within a range of record numbers.
    """
    key = F.struct(F.when(F.col("ref_id") < 0, F.lit(2**31 - 1)).otherwise(F.col("ref_id")).alias("r"), F.col("pos").alias("p"))
    rows = with_neighbour(reads.select("rec_no", key.alias("key")), "rec_no", -1, F.col("key"), "before")
    return rows.agg(F.count("*").alias("n_records"), F.count_if(F.col("key") < F.col("before")).alias("n_out_of_order"))
