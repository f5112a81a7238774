"""The registered queries of the library's operators, each beside its DuckDB equivalent.

Inputs are the reads and refs projected from the driver's tables (plans/driver_tables.py). Ordering
operators emit an explicit ordinal, so that their order is part of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions import flags as FL
from readloom.functions import hashing as H
from readloom.functions import names as N
from readloom.functions import sequence as SQ
from readloom.functions.ordinals import number_sorted, with_ordinal
from readloom.operators import depth, index, region, sample, sort, zmw
from readloom.plans import driver_tables as D
from readloom.plans.driver_tables import LENGTHS_SQL, OPS_SQL, READS_SQL, REFS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


FIELDS = ["rec_no", "qname", "flag", "ref_id", "pos", "mapq"]
F_SQL = ", ".join(FIELDS)
REGION = (3, 20_000, 60_000)
EXCLUDED = 0x704


# --- depth ---------------------------------------------------------------------------------

_COVERED = f"""WITH {READS_SQL}, {OPS_SQL}, {REFS_SQL},
spans AS (
  SELECT r.ref_id, o.op, r.pos + coalesce(sum(CASE WHEN o.op IN ('M', 'D', 'N', '=', 'X') THEN o.len ELSE 0 END)
      OVER (PARTITION BY r.rec_no ORDER BY o.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg, o.len
  FROM reads r JOIN op o USING (rec_no) WHERE (r.flag & {EXCLUDED}) = 0 AND r.ref_id >= 0),
cut AS (
  SELECT s.ref_id, s.beg, least(s.beg + s.len, f.length) AS fin FROM spans s JOIN refs f USING (ref_id)
  WHERE s.op IN ('M', 'D', '=', 'X') AND s.beg < least(s.beg + s.len, f.length))"""


@register(
    f"""{_COVERED},
pieces AS (SELECT ref_id, beg, fin, unnest(range((beg // 1000)::BIGINT, ((fin - 1) // 1000)::BIGINT + 1)) AS bin FROM cut),
sums AS (SELECT ref_id, bin, sum(least(fin, (bin + 1) * 1000) - greatest(beg, bin * 1000))::BIGINT AS bases FROM pieces GROUP BY ref_id, bin),
grid AS (SELECT ref_id, name, length, unnest(range(0, (length - 1) // 1000 + 1)) AS bin FROM refs)
SELECT g.ref_id, g.name AS contig, (g.bin * 1000)::BIGINT AS start, least((g.bin + 1) * 1000, g.length)::BIGINT AS "end",
  coalesce(s.bases, 0)::BIGINT AS depth_bases, coalesce(s.bases, 0)::DOUBLE / (least((g.bin + 1) * 1000, g.length) - g.bin * 1000) AS mean_depth
FROM grid g LEFT JOIN sums s ON g.ref_id = s.ref_id AND g.bin = s.bin"""
)
def depth_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.binned_depth(D.reads(spark, sf_dir, numbered=False), D.refs(spark, sf_dir))


@register(
    f"""{_COVERED}
SELECT (SELECT count(*) FROM reads) AS records, (SELECT count(*) FROM reads WHERE (flag & {EXCLUDED}) = 0 AND ref_id >= 0) AS counted_records,
  (SELECT sum(fin - beg)::BIGINT FROM cut) AS depth_bases, (SELECT sum((length + 999) // 1000)::BIGINT FROM refs) AS bins, 1000::BIGINT AS bin_size"""
)
def depth_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.depth_totals(D.reads(spark, sf_dir, numbered=False), D.refs(spark, sf_dir))


# --- region filters and joins --------------------------------------------------------------


@register(f"WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL} SELECT {F_SQL} FROM lens WHERE ref_id = {REGION[0]} AND pos < {REGION[2]} AND pos + ref_len > {REGION[1]}")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir).where(region.overlaps(*REGION)).select(FIELDS)


@register(f"WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL} SELECT {F_SQL} FROM lens WHERE ref_id = {REGION[0]} AND pos < {REGION[2]} AND greatest(pos + ref_len, pos + 1) > {REGION[1]}")
def region_overlap_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir).where(region.overlaps_nonempty(*REGION)).select(FIELDS)


@register(f"WITH {READS_SQL} SELECT {F_SQL} FROM reads WHERE ref_id < 0")
def unmapped_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region.query_region(D.reads(spark, sf_dir), D.refs(spark, sf_dir), region.parse_region("*")).select(FIELDS)


@register(f"WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL}, {REFS_SQL} SELECT {F_SQL} FROM lens JOIN refs USING (ref_id) WHERE name = 'NATION_18' AND pos < 50000 AND pos + ref_len > 999")
def region_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region.query_region(D.reads(spark, sf_dir), D.refs(spark, sf_dir), region.parse_region("NATION_18:1000-50000")).select(FIELDS)


_BIN_SQL = """CASE WHEN b // 16384 = e // 16384 THEN 4681 + b // 16384 WHEN b // 131072 = e // 131072 THEN 585 + b // 131072
  WHEN b // 1048576 = e // 1048576 THEN 73 + b // 1048576 WHEN b // 8388608 = e // 8388608 THEN 9 + b // 8388608
  WHEN b // 67108864 = e // 67108864 THEN 1 + b // 67108864 ELSE 0 END"""


@register(
    f"""WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL}
SELECT rec_no, CASE WHEN pos < 0 THEN 4680 ELSE {_BIN_SQL} END::INT AS bin FROM (SELECT *, pos::BIGINT AS b, greatest(pos + ref_len, pos + 1) - 1 AS e FROM lens)"""
)
def reg2bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.greatest(C.reference_end(F.col("pos"), F.col("cigar")), F.col("pos").cast("bigint") + 1)
    return D.reads(spark, sf_dir).select("rec_no", C.reg2bin(F.col("pos"), end).alias("bin"))


@register(
    f"""WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL},
iv AS (SELECT p_partkey AS interval_id, CAST(p_partkey % 25 AS INT) AS ref_id, ((p_partkey * 37) % 90000)::BIGINT AS beg, ((p_partkey * 37) % 90000 + 10 + p_size * 4)::BIGINT AS fin FROM part)
SELECT rec_no, interval_id FROM lens l JOIN iv ON l.ref_id = iv.ref_id AND l.pos < iv.fin AND greatest(l.pos + l.ref_len, l.pos + 1) > iv.beg"""
)
def bin_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = D.table(spark, sf_dir, "part")
    beg = (F.col("p_partkey") * 37) % 90000
    intervals = part.select(F.col("p_partkey").alias("interval_id"), (F.col("p_partkey") % 25).cast("int").alias("ref_id"), beg.alias("beg"), (beg + 10 + F.col("p_size") * 4).alias("end"))
    return region.bin_join(D.reads(spark, sf_dir), intervals).select("rec_no", "interval_id")


@register(f"WITH {READS_SQL}, {REFS_SQL} SELECT rec_no, coalesce(name, '*') AS rname FROM reads LEFT JOIN refs USING (ref_id)")
def refname_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir).join(D.refs(spark, sf_dir), "ref_id", "left").select("rec_no", F.coalesce("name", F.lit("*")).alias("rname"))


@register(f"WITH {READS_SQL} SELECT {F_SQL} FROM reads ORDER BY rec_no LIMIT 500")
def record_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir).orderBy("rec_no").limit(500).select(FIELDS)


# --- flags and CIGAR -----------------------------------------------------------------------


@register(
    f"""WITH {READS_SQL} SELECT rec_no, (flag & 4) = 0 AS mapped, (flag & 16) <> 0 AS reverse, (flag & 2304) = 0 AS primary_, (flag & 256) <> 0 AS secondary,
  (flag & 2048) <> 0 AS supplementary FROM reads"""
)
def flag_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("flag")
    return D.reads(spark, sf_dir).select(
        "rec_no",
        FL.is_mapped(flag).alias("mapped"),
        FL.is_reverse(flag).alias("reverse"),
        FL.is_primary(flag).alias("primary_"),
        FL.is_secondary(flag).alias("secondary"),
        FL.is_supplementary(flag).alias("supplementary"),
    )


@register(f"WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL} SELECT rec_no, ref_len, query_len, (pos + ref_len)::BIGINT AS ref_end FROM lens")
def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cigar")
    return D.reads(spark, sf_dir).select("rec_no", C.reference_length(c).alias("ref_len"), C.query_length(c).alias("query_len"), C.reference_end(F.col("pos"), c).alias("ref_end"))


def _sum_sql(ops: str) -> str:
    return f"coalesce(sum(CASE WHEN op IN ({ops}) THEN len ELSE 0 END), 0)::BIGINT"


@register(
    f"""WITH {READS_SQL}, {OPS_SQL}, s AS (
  SELECT r.rec_no, {_sum_sql("'M', '='")} AS matches, {_sum_sql("'X'")} AS mismatches, {_sum_sql("'I'")} AS insertions, {_sum_sql("'D'")} AS deletions,
    count(CASE WHEN op = 'I' THEN 1 END) AS insertion_events, count(CASE WHEN op = 'D' THEN 1 END) AS deletion_events
  FROM reads r LEFT JOIN op USING (rec_no) GROUP BY r.rec_no)
SELECT *, matches + mismatches + insertions AS aligned_bases, matches + mismatches + insertions AS span,
  CASE WHEN matches + mismatches + insertions + deletions > 0 THEN 100.0::DOUBLE * matches / (matches + mismatches + insertions + deletions) ELSE 0 END::DOUBLE AS identity,
  CASE WHEN matches + mismatches + insertion_events + deletion_events > 0 THEN 100.0::DOUBLE * matches / (matches + mismatches + insertion_events + deletion_events) ELSE 0 END::DOUBLE AS gap_compressed_identity
FROM s"""
)
def cigar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir).select("rec_no", C.cigar_stats(F.col("cigar")).alias("s")).select("rec_no", "s.*")


@register(f"WITH {READS_SQL}, {OPS_SQL} SELECT ref_id, {_sum_sql("'X'")} AS mismatches FROM reads LEFT JOIN op USING (rec_no) GROUP BY ref_id")
def mismatch_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir, numbered=False).groupBy("ref_id").agg(F.sum(C.mismatches(F.col("cigar"))).alias("mismatches"))


@register(f"WITH {READS_SQL} SELECT rec_no, cigar_text FROM reads")
def cigar_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir).select("rec_no", C.format_cigar(F.col("cigar")).alias("cigar_text"))


@register(
    f"""WITH {READS_SQL}, {OPS_SQL}
SELECT rec_no, (i - 1)::INT AS i, op, len::INT AS len,
  (pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER w, 0))::BIGINT AS ref_beg,
  coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER w, 0)::BIGINT AS query_beg
FROM reads JOIN op USING (rec_no) WINDOW w AS (PARTITION BY rec_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def cigar_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir).select("rec_no", F.posexplode(C.op_positions(F.col("pos"), F.col("cigar"))).alias("i", "o")).select("rec_no", "i", "o.*")


# --- names and hashes ----------------------------------------------------------------------


@register(
    f"""WITH {READS_SQL} SELECT rec_no, split_part(qname, '/', 1) AS movie, CAST(split_part(qname, '/', 2) AS INT) AS hole,
  CAST(split_part(split_part(qname, '/', 3), '_', 1) AS INT) AS query_start, CAST(split_part(split_part(qname, '/', 3), '_', 2) AS INT) AS query_end FROM reads"""
)
def query_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("qname")
    return D.reads(spark, sf_dir).select(
        "rec_no", N.movie(name).alias("movie"), N.hole_number(name).alias("hole"), N.query_start(name).alias("query_start"), N.query_end(name, F.col("qlen")).alias("query_end")
    )


@register(
    """SELECT c_custkey, left(md5(c_name || '//' || c_mktsegment), 8) AS rg,
  ((('0x' || left(md5(c_name || '//' || c_mktsegment), 8))::BIGINT + 2147483648) % 4294967296 - 2147483648)::INT AS rg_number FROM customer"""
)
def rg_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rg = N.read_group_hash(F.col("c_name"), F.col("c_mktsegment"))
    return D.table(spark, sf_dir, "customer").select("c_custkey", rg.alias("rg"), N.read_group_number(rg).alias("rg_number"))


_NAME_BUCKET_SQL = """x AS (
  SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(qname) + 1), lambda i: ascii(substr(qname, i::INT, 1))::BIGINT)),
    lambda h, c: (h * 31 + c) % 4294967296) AS k0 FROM reads),
x1 AS (SELECT *, (k0 + (4294967295 - (k0 * 32768) % 4294967296)) % 4294967296 AS k1 FROM x),
x2 AS (SELECT *, xor(k1, k1 // 1024) AS k2 FROM x1),
x3 AS (SELECT *, (k2 + k2 * 8) % 4294967296 AS k3 FROM x2),
x4 AS (SELECT *, xor(k3, k3 // 64) AS k4 FROM x3),
x5 AS (SELECT *, (k4 + (4294967295 - (k4 * 2048) % 4294967296)) % 4294967296 AS k5 FROM x4),
sampled AS (SELECT *, xor(k5, k5 // 65536) % 16777216 AS bucket FROM x5)"""


@register(f"WITH {READS_SQL}, {_NAME_BUCKET_SQL} SELECT {F_SQL} FROM sampled WHERE bucket < {H.fraction_cutoff(0.1)}")
def fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.fraction_sample(D.reads(spark, sf_dir), 0.1).select(FIELDS)


_M = "18446744073709551616::UHUGEINT"
_ZMW_BUCKET_SQL = f"""z AS (
  SELECT *, xor((rg_id::UBIGINT * 4294967296::UBIGINT + zmw::UBIGINT)::UBIGINT, {5 * H.GOLDEN & H.MASK64}::UBIGINT) AS z0 FROM reads),
z1 AS (SELECT *, ((xor(z0, z0 // 1073741824::UBIGINT)::UHUGEINT * {H.MIX_A}::UHUGEINT) % {_M})::UBIGINT AS a FROM z),
z2 AS (SELECT *, ((xor(a, a // 134217728::UBIGINT)::UHUGEINT * {H.MIX_B}::UHUGEINT) % {_M})::UBIGINT AS b FROM z1),
hashed AS (SELECT *, (xor(b, b // 2147483648::UBIGINT) // 1099511627776::UBIGINT)::BIGINT AS bucket FROM z2)"""


@register(f"WITH {READS_SQL}, {_ZMW_BUCKET_SQL} SELECT bucket, count(*) AS records, sum(qlen)::BIGINT AS bases FROM hashed GROUP BY bucket")
def yield_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.yield_histogram(D.reads(spark, sf_dir, numbered=False), seed=5)


@register(
    f"""WITH {READS_SQL}, {_ZMW_BUCKET_SQL}, h AS (SELECT bucket, sum(sum(qlen)) OVER (ORDER BY bucket) AS upto FROM hashed GROUP BY bucket),
cut AS (SELECT coalesce(min(bucket) + 1, 16777216) AS c FROM h WHERE upto >= 300000)
SELECT {F_SQL} FROM hashed, cut WHERE bucket < c"""
)
def yield_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.yield_sample(D.reads(spark, sf_dir), sample.parse_yield("300K"), seed=5).select(FIELDS)


@register(
    f"""WITH {READS_SQL}, {_NAME_BUCKET_SQL} SELECT count(*) AS records, sum(qlen)::BIGINT AS bases, count(CASE WHEN bucket < {H.fraction_cutoff(0.25)} THEN 1 END) AS kept_records,
  sum(CASE WHEN bucket < {H.fraction_cutoff(0.25)} THEN qlen ELSE 0 END)::BIGINT AS kept_bases FROM sampled"""
)
def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.kept_counts(D.reads(spark, sf_dir, numbered=False), H.name_bucket(F.col("qname")) < H.fraction_cutoff(0.25))


# --- molecules -----------------------------------------------------------------------------

_WANTED = "SELECT DISTINCT CAST(l_suppkey AS INT) AS rg_id, CAST(l_orderkey AS INT) AS zmw FROM lineitem WHERE l_quantity = 7"


@register(f"WITH {READS_SQL} SELECT {F_SQL} FROM reads SEMI JOIN ({_WANTED}) USING (rg_id, zmw)")
def whitelist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.reads(spark, sf_dir)
    return zmw.whitelist(rows, rows.where("qlen = 7").select("rg_id", "zmw")).select(FIELDS)


@register(f"WITH {READS_SQL} SELECT {F_SQL} FROM reads WHERE zmw = 100")
def zmw_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.zmw_point(D.reads(spark, sf_dir), 100).select(FIELDS)


@register(f"WITH {READS_SQL} SELECT req, rec_no FROM reads JOIN (SELECT CAST(o_custkey AS INT) AS rg_id, CAST(o_orderkey AS INT) AS zmw, o_orderkey AS req FROM orders) USING (rg_id, zmw)")
def identity_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("rg_id"), F.col("o_orderkey").cast("int").alias("zmw"), F.col("o_orderkey").alias("req"))
    return zmw.identity_batch(D.reads(spark, sf_dir), wanted).select("req", "rec_no")


@register(f"WITH {READS_SQL} SELECT rg_id, zmw, (min(rec_no) * 97)::BIGINT AS voffset FROM reads GROUP BY rg_id, zmw")
def first_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.first_offset(D.reads(spark, sf_dir).withColumn("voffset", F.col("rec_no") * 97))


@register(f"WITH {READS_SQL} SELECT rg_id, zmw, min(rec_no) AS first_rec, (row_number() OVER (ORDER BY min(rec_no)) - 1)::BIGINT AS zmw_no, count(*) AS n_records FROM reads GROUP BY rg_id, zmw")
def unique_zmws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.numbered_zmws(D.reads(spark, sf_dir))


@register(f"WITH {READS_SQL} SELECT rg_id, zmw, count(*) AS n_records FROM reads GROUP BY rg_id, zmw")
def zmw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir, numbered=False).groupBy("rg_id", "zmw").agg(F.count("*").alias("n_records"))


@register(f"WITH {READS_SQL} SELECT count(*) AS n_zmws FROM (SELECT DISTINCT rg_id, zmw FROM reads)")
def zmw_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.count_zmws(D.reads(spark, sf_dir, numbered=False))


_RUNS_SQL = """runs AS (SELECT rec_no, sum(new) OVER (ORDER BY rec_no)::BIGINT AS run_id FROM (
  SELECT rec_no, CASE WHEN zmw = lag(zmw) OVER (ORDER BY rec_no) AND 0 = lag(0) OVER (ORDER BY rec_no) THEN 0 ELSE 1 END AS new FROM reads))"""


def _molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered reads of one read group."""
    return D.reads(spark, sf_dir).select("rec_no", F.lit(0).alias("rg_id"), "zmw", "qname")


@register(f"WITH {READS_SQL}, {_RUNS_SQL} SELECT rec_no, run_id FROM runs")
def zmw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.zmw_runs(_molecules(spark, sf_dir)).select("rec_no", "run_id")


@register(f"WITH {READS_SQL}, {_RUNS_SQL} SELECT run_id, min(rec_no) AS first_rec, count(*) AS n_records FROM runs GROUP BY run_id")
def zmw_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = zmw.zmw_groups(_molecules(spark, sf_dir))
    return groups.select("run_id", F.col("records")[0]["rec_no"].alias("first_rec"), F.size("records").cast("bigint").alias("n_records"))


_NUMBERED = f"WITH {READS_SQL}, u AS (SELECT rg_id, zmw, row_number() OVER (ORDER BY min(rec_no)) - 1 AS zmw_no FROM reads GROUP BY rg_id, zmw)"


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered reads as a molecule index has them."""
    return D.reads(spark, sf_dir).select("rec_no", "rg_id", "zmw")


@register(f"{_NUMBERED}, t AS (SELECT count(*) AS n FROM u) SELECT rec_no, zmw_no::BIGINT AS zmw_no FROM reads JOIN u USING (rg_id, zmw), t WHERE zmw_no >= n * 2 // 7 AND zmw_no < n * 3 // 7")
def chunk_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.contiguous_chunk(_identities(spark, sf_dir), 3, 7).select("rec_no", "zmw_no")


#: Scatter runs over a hundred molecules made of the customers, few enough for the oracle to list the permutation.
_TILES = ", ".join(f"({t})" for t in zmw.scatter_tiles(100, 2, 4, 3, 7))


def _customers_as_zmws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_no"), F.lit(0).alias("rg_id"), (F.col("o_custkey") % 100).cast("int").alias("zmw"))
    return rows


@register(
    f"""WITH r AS (SELECT o_orderkey AS rec_no, CAST(o_custkey % 100 AS INT) AS zmw FROM orders),
u AS (SELECT zmw, row_number() OVER (ORDER BY min(rec_no)) - 1 AS zmw_no FROM r GROUP BY zmw)
SELECT rec_no, zmw_no::BIGINT AS zmw_no FROM r JOIN u USING (zmw) WHERE zmw_no // 3 IN (SELECT * FROM (VALUES {_TILES}))"""
)
def chunk_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.scatter_chunk(_customers_as_zmws(spark, sf_dir), 2, 4, tile=3, seed=7).select("rec_no", "zmw_no")


#: The shuffle of all tiles in SQL: number k of the stream is made from seed + k * golden, and the swaps are applied in turn.
#: A drawn number is refused with a probability of tiles / 2 ** 64 only, which the SQL leaves out.
_SHUFFLED = f"""u2 AS (SELECT count(*) AS n_zmws, (count(*) + 2) // 3 AS n FROM u),
z0 AS (SELECT n, i, ((7 + (n - i + 1)::UHUGEINT * {H.GOLDEN}::UHUGEINT) % 18446744073709551616::UHUGEINT) AS z FROM (SELECT n, unnest(range(n - 1, 0, -1)) AS i FROM u2)),
z1 AS (SELECT n, i, xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM z0),
z2 AS (SELECT n, i, xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM z1),
swaps AS (SELECT list([i + 1, (xor(z, z // 2147483648::UHUGEINT) % (i + 1)::UHUGEINT)::BIGINT + 1] ORDER BY i DESC) AS js FROM z2),
shuffled AS (SELECT n, list_reduce(js, lambda a, x: CASE WHEN x[1] = x[2] THEN a ELSE a[:x[2] - 1] || [a[x[1]]] || a[x[2] + 1:x[1] - 1] || [a[x[2]]] || a[x[1] + 1:] END, range(n)) AS p FROM swaps, u2),
chosen AS (SELECT unnest(p[n // 4 + 1:n * 2 // 4]) AS tile FROM shuffled)"""


@register(f"{_NUMBERED}, {_SHUFFLED} SELECT rec_no, zmw_no::BIGINT AS zmw_no FROM reads JOIN u USING (rg_id, zmw) WHERE zmw_no // 3 IN (SELECT tile FROM chosen)")
def chunk_scatter_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_scatter over all molecules of the reads."""
    return zmw.scatter_chunk(_identities(spark, sf_dir), 2, 4, tile=3, seed=7).select("rec_no", "zmw_no")


def _barcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reads(spark, sf_dir).withColumns({"fwd": F.col("zmw") % 8 - 1, "rev": F.col("rg_id") % 5, "voffset": F.col("rec_no") * 97})


@register(f"WITH {READS_SQL} SELECT (zmw % 8 - 1)::INT AS fwd, (rg_id % 5)::INT AS rev, count(*) AS n_records FROM reads GROUP BY 1, 2")
def barcode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.barcode_pairs(_barcoded(spark, sf_dir))


@register(f"WITH {READS_SQL} SELECT rec_no, (rec_no * 97)::BIGINT AS voffset FROM reads WHERE zmw % 8 - 1 = 2 AND rg_id % 5 = 3")
def barcode_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zmw.barcode_offsets(_barcoded(spark, sf_dir), 2, 3)


# --- sorting, merging, concatenation -------------------------------------------------------

_COORD = "CASE WHEN ref_id < 0 THEN 2147483647 ELSE ref_id END, pos, (flag & 16) <> 0"


def _ordered(rows: DataFrame, keys: list) -> DataFrame:
    return number_sorted(rows, [*keys, *sort.origin(rows)], "ord")


@register(f"WITH {READS_SQL} SELECT rec_no, row_number() OVER (ORDER BY {_COORD}, rec_no)::BIGINT AS ord FROM reads")
def sort_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(D.reads(spark, sf_dir).select("rec_no", "ref_id", "pos", "flag"), sort.coordinate_keys()).select("rec_no", "ord")


_NATURAL = """list_aggregate(list_transform(regexp_extract_all(qname, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN ascii(p) BETWEEN 48 AND 57
  THEN '0' || upper(printf('%02x', length(ltrim(p, '0')))) || ltrim(p, '0') || upper(printf('%02x', length(p) - length(ltrim(p, '0')))) ELSE p END), 'string_agg', '')"""


@register(f"WITH {READS_SQL} SELECT rec_no, row_number() OVER (ORDER BY {_NATURAL}, flag & 192, rec_no)::BIGINT AS ord FROM reads")
def sort_queryname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(D.reads(spark, sf_dir).select("rec_no", "qname", "flag"), sort.queryname_keys()).select("rec_no", "ord")


@register(f"WITH {READS_SQL} SELECT rec_no, row_number() OVER (ORDER BY tag_number IS NOT NULL, tag_number NULLS LAST, {_COORD}, rec_no)::BIGINT AS ord FROM reads")
def sort_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(D.reads(spark, sf_dir).select("rec_no", "ref_id", "pos", "flag", "tag_number"), sort.tag_keys(F.col("tag_number"))).select("rec_no", "ord")


@register(f"WITH {READS_SQL} SELECT rec_no, row_number() OVER (ORDER BY tag_text, {_COORD}, rec_no)::BIGINT AS ord FROM reads")
def sort_tag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(D.reads(spark, sf_dir).select("rec_no", "ref_id", "pos", "flag", "tag_text"), sort.tag_keys(text=F.col("tag_text"))).select("rec_no", "ord")


def _inputs(spark: SparkSession, sf_dir: str, columns: list[str]) -> list[DataFrame]:
    rows = D.reads(spark, sf_dir).select(columns)
    return [rows.where(F.col("rec_no") % 4 == k) for k in range(4)]


@register(f"WITH {READS_SQL} SELECT rec_no, (rec_no % 4)::INT AS file_ord, row_number() OVER (ORDER BY {_COORD}, rec_no % 4, rec_no)::BIGINT AS ord FROM reads")
def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sort.numbered_inputs(_inputs(spark, sf_dir, ["rec_no", "ref_id", "pos", "flag"]))
    return _ordered(rows, sort.coordinate_keys()).select("rec_no", "file_ord", "ord")


@register(f"WITH {READS_SQL} SELECT rec_no, (rec_no % 4)::INT AS file_ord, row_number() OVER (ORDER BY {_NATURAL}, flag & 192, rec_no % 4, rec_no)::BIGINT AS ord FROM reads")
def merge_queryname(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sort.numbered_inputs(_inputs(spark, sf_dir, ["rec_no", "qname", "flag"]))
    return _ordered(rows, sort.queryname_keys()).select("rec_no", "file_ord", "ord")


@register(f"WITH {READS_SQL} SELECT rec_no, (rec_no % 4)::INT AS file_ord, row_number() OVER (ORDER BY rec_no % 4, rec_no)::BIGINT AS ord FROM reads")
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sort.concat(_inputs(spark, sf_dir, ["rec_no"]))
    return with_ordinal(rows, F.col("file_ord") * 2**40 + F.expr("rec_no div 16384"), [F.col("file_ord"), F.col("rec_no")], "ord", first=1)


@register(
    f"""WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL} SELECT rec_no, (rec_no % 4)::INT AS file_ord, row_number() OVER (ORDER BY ref_id, pos, qname, rec_no % 4, rec_no)::BIGINT AS ord
FROM lens WHERE ref_id = {REGION[0]} AND pos < {REGION[2]} AND pos + ref_len > {REGION[1]}"""
)
def multi_bam_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sort.numbered_inputs(_inputs(spark, sf_dir, ["rec_no", "qname", "flag", "ref_id", "pos", "cigar"]))
    return _ordered(rows.where(region.overlaps(*REGION)), [F.col("ref_id"), F.col("pos"), F.col("qname")]).select("rec_no", "file_ord", "ord")


@register(
    f"""WITH {READS_SQL} SELECT count(*) AS n_records, count(CASE WHEN k < p OR (k = p AND pos < pp) THEN 1 END) AS n_out_of_order FROM (
  SELECT pos, lag(pos) OVER w AS pp, CASE WHEN ref_id < 0 THEN 2147483647 ELSE ref_id END AS k,
    lag(CASE WHEN ref_id < 0 THEN 2147483647 ELSE ref_id END) OVER w AS p FROM reads WINDOW w AS (ORDER BY rec_no))"""
)
def sortedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort.disorder(D.reads(spark, sf_dir))


@register("SELECT ref_id, count(*) AS n, count(*) AS n_distinct FROM (SELECT CAST(l_suppkey % 25 AS INT) AS ref_id FROM lineitem) WHERE false GROUP BY ref_id")
def empty_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = region.query_region(D.reads(spark, sf_dir, numbered=False), D.refs(spark, sf_dir), region.Region("no such reference"))
    return rows.groupBy("ref_id").agg(F.count("*").alias("n"), F.count("*").alias("n_distinct"))


# --- index builders ------------------------------------------------------------------------

_SORTED_SQL = f"""sorted AS (
  SELECT *, (ord * 100)::BIGINT AS beg_vo, (ord * 100 + 100)::BIGINT AS end_vo FROM (
    SELECT *, row_number() OVER (ORDER BY {_COORD}, rec_no)::BIGINT AS ord FROM lens))"""
_INDEXED = f"WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL}, {_SORTED_SQL}"


def _sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads in coordinate order, each 100 offsets long."""
    rows = D.reads(spark, sf_dir).select("rec_no", "ref_id", "pos", "flag", "cigar")
    ref = F.when(F.col("ref_id") < 0, F.lit(2**31 - 1)).otherwise(F.col("ref_id")).cast("bigint")
    bucket = ref * 2**20 + F.when(F.col("ref_id") < 0, F.expr("rec_no div 16384")).otherwise(F.expr("pos div 128"))
    rows = with_ordinal(rows, bucket, [*sort.coordinate_keys(), F.col("rec_no")], "ord", first=1)
    return rows.select(F.col("ord").alias("rec_no"), "ref_id", "pos", "flag", "cigar", (F.col("ord") * 100).alias("voffset"), (F.col("ord") * 100 + 100).alias("end_voffset"))


@register(f"{_INDEXED} SELECT ord AS rec_no, beg_vo AS voffset, coalesce(lead(beg_vo) OVER (ORDER BY ord), 7)::BIGINT AS end_voffset FROM sorted")
def end_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_end_offset(_sorted_file(spark, sf_dir).drop("end_voffset"), 7).select("rec_no", "voffset", F.col("end_voffset").cast("bigint").alias("end_voffset"))


_BINNED = f"""binned AS (SELECT ref_id, ({_BIN_SQL})::INT AS bin, beg_vo AS beg, end_vo AS fin
  FROM (SELECT *, pos::BIGINT AS b, greatest(pos + ref_len, pos + 1) - 1 AS e FROM sorted WHERE ref_id >= 0 AND (flag & 4) = 0)),
marked AS (SELECT *, CASE WHEN beg <= max(fin) OVER (PARTITION BY ref_id, bin ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM binned),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY ref_id, bin ORDER BY beg, fin) AS run FROM marked),
chunks AS (SELECT ref_id, bin, min(beg)::BIGINT AS beg, max(fin)::BIGINT AS "end" FROM numbered GROUP BY ref_id, bin, run)"""


@register(f"{_INDEXED}, {_BINNED} SELECT * FROM chunks")
def bai_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bai_bins(_sorted_file(spark, sf_dir))


@register(
    f"""{_INDEXED}, w AS (SELECT ref_id, beg_vo, unnest(range((pos // 16384)::BIGINT, ((greatest(pos + ref_len, pos + 1) - 1) // 16384)::BIGINT + 1)) AS win
  FROM sorted WHERE ref_id >= 0 AND (flag & 4) = 0) SELECT ref_id, win::INT AS win, min(beg_vo) AS voffset FROM w GROUP BY ref_id, win"""
)
def bai_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bai_linear(_sorted_file(spark, sf_dir))


@register(
    f"""{_INDEXED} SELECT ref_id, min(beg_vo) AS beg, max(end_vo) AS "end", count(CASE WHEN (flag & 4) = 0 THEN 1 END) AS n_mapped, count(CASE WHEN (flag & 4) <> 0 THEN 1 END) AS n_unmapped
FROM sorted WHERE ref_id >= 0 GROUP BY ref_id"""
)
def bai_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bai_meta(_sorted_file(spark, sf_dir))


@register(f"WITH {READS_SQL} SELECT count(*) AS n_no_coor FROM reads WHERE ref_id < 0")
def bai_no_coor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.no_coordinate_count(D.reads(spark, sf_dir, numbered=False))


_WANTED_BINS = ", ".join(map(str, C.bins_of(*REGION[1:])))


@register(
    f"""{_INDEXED}, {_BINNED}, lin AS (SELECT min(beg_vo) AS least FROM sorted WHERE ref_id = {REGION[0]} AND (flag & 4) = 0
    AND pos // 16384 <= {REGION[1] >> 14} AND (greatest(pos + ref_len, pos + 1) - 1) // 16384 >= {REGION[1] >> 14}),
kept AS (SELECT beg, "end" AS fin FROM chunks, lin WHERE ref_id = {REGION[0]} AND bin IN ({_WANTED_BINS}) AND "end" > least),
m2 AS (SELECT *, CASE WHEN beg <= max(fin) OVER (ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM kept),
n2 AS (SELECT *, sum(new) OVER (ORDER BY beg, fin) AS run FROM m2)
SELECT min(beg)::BIGINT AS beg, max(fin)::BIGINT AS "end" FROM n2 GROUP BY run"""
)
def bai_query_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sorted_file(spark, sf_dir)
    return region.index_chunks(index.bai_bins(rows), index.bai_linear(rows), *REGION)


@register(
    """WITH r AS (SELECT user_id, event_id * 3 AS beg, event_id * 3 + (event_id % 97) * 400 AS fin FROM events),
m AS (SELECT *, CASE WHEN beg <= max(fin) OVER (PARTITION BY user_id ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY beg, fin) AS run FROM m)
SELECT user_id, min(beg)::BIGINT AS beg, max(fin)::BIGINT AS "end" FROM n GROUP BY user_id, run"""
)
def coalesce_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return index.coalesce_ranges(D.table(spark, sf_dir, "events").select("user_id", (e * 3).alias("beg"), (e * 3 + (e % 97) * 400).alias("end")), ["user_id"])


_SPANS_SQL = f"""{_INDEXED}, spans AS (SELECT (ord // 1000)::BIGINT AS slice, ref_id, CASE WHEN ref_id >= 0 THEN min(pos) + 1 ELSE 0 END::BIGINT AS start,
  CASE WHEN ref_id >= 0 THEN max(greatest(pos + ref_len, pos + 1)) - min(pos) ELSE 0 END::BIGINT AS span, count(*) AS n_records FROM sorted GROUP BY 1, 2)"""


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.slice_spans(_sorted_file(spark, sf_dir).withColumn("slice", F.expr("rec_no div 1000")))


@register(f"{_SPANS_SQL} SELECT * FROM spans")
def slice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir)


@register(
    f"""{_SPANS_SQL} SELECT DISTINCT (slice // 4)::BIGINT AS container, slice, n_records AS size FROM spans
WHERE ref_id = {REGION[0]} AND start - 1 < {REGION[2]} AND start - 1 + greatest(span, 1) > {REGION[1]}"""
)
def crai_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    crai = _sliced(spark, sf_dir).select(F.col("ref_id").alias("seq_id"), "start", "span", F.expr("slice div 4").alias("container"), "slice", F.col("n_records").alias("size"))
    return region.crai_slices(crai, *REGION)


@register(
    f"""{_INDEXED}, m AS (SELECT *, ord // 500 AS slice, CASE WHEN ord % 6 = 0 THEN ord % 4 ELSE -1 END AS nf FROM sorted),
p AS (SELECT a.ord AS a, b.ord AS b, a.ref_id AS ar, b.ref_id AS br, a.pos AS ap, b.pos AS bp,
  CASE WHEN a.ref_id = b.ref_id AND a.ref_id >= 0 THEN greatest(a.pos + a.ref_len, b.pos + b.ref_len) - least(a.pos, b.pos) ELSE 0 END * CASE WHEN a.pos <= b.pos THEN 1 ELSE -1 END AS t
  FROM m a JOIN m b ON a.slice = b.slice AND b.ord = a.ord + a.nf + 1 WHERE a.nf >= 0)
SELECT a AS rec_no, br AS next_ref_id, bp AS next_pos, t::BIGINT AS tlen FROM p UNION ALL SELECT b, ar, ap, (-t)::BIGINT FROM p"""
)
def mate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sorted_file(spark, sf_dir).withColumns(
        {"slice": F.expr("rec_no div 500"), "ord": F.col("rec_no"), "nf": F.when(F.col("rec_no") % 6 == 0, F.col("rec_no") % 4).otherwise(-1)}
    )
    return index.resolve_mates(rows)


@register(f"WITH {READS_SQL} SELECT min(rec_no) AS first_bad FROM reads WHERE rec_no % 5000 = 4999")
def positional_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.reads(spark, sf_dir)
    stale = rows.withColumn("qlen", F.when(F.col("rec_no") % 5000 == 4999, F.col("qlen") + 1).otherwise(F.col("qlen")))
    return index.positional_mismatch(rows, stale)


# --- sequences and text --------------------------------------------------------------------


@register(
    f"""SELECT doc_id, translate(regexp_replace(translate(reverse(s), 'Uu', 'Tt'), '[^{SQ.LETTERS}]', 'N', 'g'), '{SQ.LETTERS}', '{SQ.COMPLEMENTS}') AS rc
FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z=.]', '', 'g') AS s FROM documents)"""
)
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.regexp_replace("text", "[^A-Za-z=.]", "")
    return D.table(spark, sf_dir, "documents").select("doc_id", SQ.reverse_complement(seq).alias("rc"))


@register(
    f"""WITH {READS_SQL}, {REFS_SQL} SELECT rec_no, qname || chr(9) || flag || chr(9) || coalesce(name, '*') || chr(9) || (pos + 1) || chr(9) || mapq || chr(9) || cigar_text || chr(9) || '*' || chr(9)
  || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || 'zm:i:' || zmw AS line FROM reads LEFT JOIN refs USING (ref_id)"""
)
def sam_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.functions.sam_text import sam_line as line

    rows = D.reads(spark, sf_dir).join(D.refs(spark, sf_dir), "ref_id", "left")
    full = rows.select(
        "rec_no",
        "qname",
        "flag",
        "ref_id",
        F.coalesce("name", F.lit("*")).alias("rname"),
        "pos",
        "mapq",
        "cigar",
        F.lit(-1).alias("next_ref_id"),
        F.lit("*").alias("next_rname"),
        F.lit(-1).alias("next_pos"),
        F.lit(0).alias("tlen"),
        F.lit("").alias("seq"),
        F.lit(None).cast("binary").alias("qual"),
        F.concat(F.lit("zm:i:"), F.col("zmw").cast("string")).alias("tag_line"),
    )
    return full.select("rec_no", line(F.col("tag_line")).alias("line"))


def queries() -> dict[str, Query]:
    from readloom import queries_files  # noqa: F401  registers the queries over files

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
