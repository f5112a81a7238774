"""The reads relation and its dimensions: schemas and sentinels.

A read is one alignment record. Sentinels stay in the columns (-1 for no reference, position
or barcode); null stands only for an absent tag or absent qualities. Positions are 0-based and
intervals half-open.
"""

from __future__ import annotations

from pyspark.sql import types as T

TAG = T.StructType(
    [
        T.StructField("t", T.StringType()),  # SAM type: A i f Z H B
        T.StructField("i", T.LongType()),
        T.StructField("f", T.FloatType()),
        T.StructField("s", T.StringType()),  # A, Z and H
        T.StructField("et", T.StringType()),  # element type of B: c C s S i I f
        T.StructField("ai", T.ArrayType(T.LongType())),
        T.StructField("af", T.ArrayType(T.FloatType())),
    ]
)
CIGAR = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("len", T.IntegerType())]))
READS = T.StructType(
    [
        T.StructField("file_ord", T.IntegerType()),
        T.StructField("rec_no", T.LongType()),
        T.StructField("voffset", T.LongType()),
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("ref_id", T.IntegerType()),
        T.StructField("rname", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("mapq", T.ShortType()),
        T.StructField("cigar", CIGAR),
        T.StructField("next_ref_id", T.IntegerType()),
        T.StructField("next_rname", T.StringType()),
        T.StructField("next_pos", T.IntegerType()),
        T.StructField("tlen", T.IntegerType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.BinaryType()),
        T.StructField("tags", T.MapType(T.StringType(), TAG)),
    ]
)
REFS = T.StructType(
    [
        T.StructField("ref_id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
READ_GROUPS = T.StructType(
    [T.StructField("ord", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))]
)
ZMW_INDEX = T.StructType(
    [
        T.StructField("rec_no", T.LongType()),
        T.StructField("rg_id", T.IntegerType()),
        T.StructField("zmw", T.IntegerType()),
        T.StructField("voffset", T.LongType()),
        T.StructField("fwd", T.IntegerType()),
        T.StructField("rev", T.IntegerType()),
        T.StructField("qlen", T.IntegerType()),
    ]
)

#: Flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048
#: Flags that take a record out of depth: unmapped, secondary, QC failure, duplicate.
DEPTH_EXCLUDED = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
INT_MAX = 2**31 - 1
