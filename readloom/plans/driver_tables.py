"""reads and refs projected from the driver's star-schema tables, as columns and as DuckDB SQL.

The tables hold no alignments; this fixed projection gives every record operator an input that
both engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.cigar import parse_cigar
from readloom.functions.ordinals import with_ordinal

MOVIE = "m84000_240101_000000_s1"
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: Order keys of one numbering range: about four records a key.
RANGE_KEYS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").cast("int").alias("ref_id"), F.col("n_name").alias("name"), (F.lit(90000) + F.col("n_nationkey") * 1000).cast("int").alias("length"))


def reads(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """rec_no, qname, flag, ref_id, pos, mapq, cigar (ops), cigar_text, rg_id, zmw, and tags for the tag operators.

    Without numbered there is no rec_no, and no exchange.
    """
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    unplaced = line == 7
    rows = table(spark, sf_dir, "lineitem")
    if numbered:
        rows = with_ordinal(rows, F.expr(f"l_orderkey div {RANGE_KEYS}"), [F.col(c) for c in ORDER], "rec_no", first=1)
    else:
        rows = rows.withColumn("rec_no", F.lit(None).cast("bigint"))
    text = F.when(unplaced, "*").otherwise(
        F.concat(
            line.cast("string"),
            F.lit("S"),
            (quantity + 5).cast("string"),
            F.lit("=1X"),
            F.when(line % 2 == 0, "3I").otherwise("4D"),
            quantity.cast("string"),
            F.lit("M"),
        )
    )
    flag = (
        F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
        + F.when((F.col("l_linestatus") == "F") & (line == 3), 256).otherwise(0)
        + F.when(line == 5, 2048).otherwise(0)
        + F.when(unplaced, 4).otherwise(0)
        + F.when(F.col("l_tax") == 0.08, 1024).otherwise(0)
    )
    out = rows.select(
        "rec_no",
        F.concat(F.lit(f"{MOVIE}/"), F.col("l_orderkey").cast("string"), F.lit("/"), (line * 100).cast("string"), F.lit("_"), (line * 100 + quantity).cast("string")).alias("qname"),
        flag.cast("int").alias("flag"),
        F.when(unplaced, -1).otherwise(F.col("l_suppkey") % 25).cast("int").alias("ref_id"),
        F.when(unplaced, -1).otherwise((F.col("l_partkey") * 977 + F.col("l_orderkey") * 131) % 100000).cast("int").alias("pos"),
        (F.col("l_orderkey") % 61).cast("int").alias("mapq"),
        text.alias("cigar_text"),
        F.col("l_suppkey").cast("int").alias("rg_id"),
        F.col("l_orderkey").cast("int").alias("zmw"),
        quantity.alias("qlen"),
        F.col("l_returnflag").alias("tag_text"),
        F.when(line == 6, None).otherwise(F.col("l_partkey")).alias("tag_number"),
    )
    return out.withColumn("cigar", parse_cigar(F.col("cigar_text")))


#: The same relations for DuckDB; ops is a list of (op, len).
READS_SQL = f"""reads AS (
  SELECT CAST(row_number() OVER (ORDER BY {", ".join(ORDER)}) AS BIGINT) AS rec_no,
    '{MOVIE}/' || l_orderkey || '/' || (l_linenumber * 100) || '_' || (l_linenumber * 100 + CAST(l_quantity AS INT)) AS qname,
    CAST(CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 256 ELSE 0 END
      + CASE WHEN l_linenumber = 5 THEN 2048 ELSE 0 END + CASE WHEN l_linenumber = 7 THEN 4 ELSE 0 END
      + CASE WHEN l_tax = 0.08 THEN 1024 ELSE 0 END AS INT) AS flag,
    CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE l_suppkey % 25 END AS INT) AS ref_id,
    CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE (l_partkey * 977 + l_orderkey * 131) % 100000 END AS INT) AS pos,
    CAST(l_orderkey % 61 AS INT) AS mapq,
    CASE WHEN l_linenumber = 7 THEN '*' ELSE l_linenumber || 'S' || (CAST(l_quantity AS INT) + 5) || '=1X'
      || CASE WHEN l_linenumber % 2 = 0 THEN '3I' ELSE '4D' END || CAST(l_quantity AS INT) || 'M' END AS cigar_text,
    CAST(l_suppkey AS INT) AS rg_id, CAST(l_orderkey AS INT) AS zmw, CAST(l_quantity AS INT) AS qlen,
    l_returnflag AS tag_text, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_partkey END AS tag_number
  FROM lineitem)"""
OPS_SQL = """ops AS (
  SELECT r.rec_no, unnest(range(1, len(o) + 1)) AS i, unnest(o) AS t
  FROM (SELECT rec_no, regexp_extract_all(cigar_text, '[0-9]+[MIDNSHP=X]') AS o FROM reads) r),
op AS (
  SELECT rec_no, i, right(t, 1) AS op, CAST(left(t, length(t) - 1) AS BIGINT) AS len FROM ops)"""
#: Per record: reference length and where each op begins.
LENGTHS_SQL = """lens AS (
  SELECT r.*, coalesce(s.ref_len, 0)::BIGINT AS ref_len, coalesce(s.query_len, 0)::BIGINT AS query_len
  FROM reads r LEFT JOIN (
    SELECT rec_no, sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END)::BIGINT AS ref_len,
      sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END)::BIGINT AS query_len
    FROM op GROUP BY rec_no) s USING (rec_no))"""
REFS_SQL = "refs AS (SELECT CAST(n_nationkey AS INT) AS ref_id, n_name AS name, CAST(90000 + n_nationkey * 1000 AS INT) AS length FROM nation)"
