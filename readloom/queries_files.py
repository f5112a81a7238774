"""Queries that pass the projected reads through the file formats and the record transforms."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions.storage import checkpoint_dir
from readloom.header import Entry, Header
from readloom.operators import clip, lossless, sort
from readloom.plans import driver_tables as D
from readloom.plans.driver_tables import LENGTHS_SQL, OPS_SQL, READS_SQL, REFS_SQL
from readloom.queries import register

_PATTERN = "ACGTTGCATTAGCCAGTACGGATC"


def _multiples(size: Column, factor: int, modulus: int) -> Column:
    """array of i * factor % modulus for i from 1 to size: a piece of a constant, which bases of the pattern never exceed twice."""
    whole = F.lit([i * factor % modulus for i in range(1, 2 * 10 * len(_PATTERN) + 1)]).cast("array<bigint>")
    return F.slice(whole, F.lit(1), size.cast("int"))


def full_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projected reads in the whole schema, with bases, qualities and two tags."""
    bases = F.substring(F.repeat(F.lit(_PATTERN), 10), F.lit(1), F.when(F.col("ref_id") < 0, F.lit(8)).otherwise(C.query_length(F.col("cigar"))).cast("int"))
    number = F.struct(
        F.lit("i").alias("t"),
        F.col("zmw").cast("bigint").alias("i"),
        F.lit(None).cast("float").alias("f"),
        F.lit(None).cast("string").alias("s"),
        F.lit(None).cast("string").alias("et"),
        F.lit(None).cast("array<bigint>").alias("ai"),
        F.lit(None).cast("array<float>").alias("af"),
    )
    track = number.withField("t", F.lit("B")).withField("i", F.lit(None).cast("bigint")).withField("et", F.lit("C"))
    track = track.withField("ai", _multiples(F.length("seq"), 7, 251))
    rows = D.reads(spark, sf_dir).join(D.refs(spark, sf_dir), "ref_id", "left").withColumn("seq", bases)
    return rows.select(
        F.lit(0).alias("file_ord"),
        "rec_no",
        (F.col("rec_no") * 100).alias("voffset"),
        "qname",
        "flag",
        "ref_id",
        F.coalesce("name", F.lit("*")).alias("rname"),
        "pos",
        F.col("mapq").cast("smallint").alias("mapq"),
        "cigar",
        F.lit(-1).alias("next_ref_id"),
        F.lit("*").alias("next_rname"),
        F.lit(-1).alias("next_pos"),
        F.lit(0).alias("tlen"),
        "seq",
        F.when(F.col("rec_no") % 3 > 0, F.unhex(F.repeat(F.lit("1E"), F.length("seq")))).alias("qual"),
        F.create_map(F.lit("zm"), number, F.lit("ip"), track).alias("tags"),
    )


def _header(spark: SparkSession, sf_dir: str) -> Header:
    refs = D.refs(spark, sf_dir).orderBy("ref_id").collect()  # the header's dimension, a few rows
    return Header({"VN": "1.6"}, [Entry(r["name"], {}, r["length"]) for r in refs])


def _folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one; the file formats open paths, so it must be mounted on all executors."""
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    if "://" in base and not base.startswith("file://"):
        raise ValueError(f"the file formats need a mounted folder, not {base}")
    path = f"{base.removeprefix('file://').removeprefix('file:')}/readloom-files-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


_FULL_SQL = f"""WITH {READS_SQL}, {OPS_SQL}, {LENGTHS_SQL}, {REFS_SQL}, whole AS (
  SELECT l.*, coalesce(name, '*') AS rname, substr(repeat('{_PATTERN}', 10), 1, CASE WHEN l.ref_id < 0 THEN 8 ELSE query_len END::INT) AS seq FROM lens l LEFT JOIN refs USING (ref_id))"""
_RECORD_SQL = f"{_FULL_SQL} SELECT qname, flag, rname, pos, mapq::INT AS mapq, {{cigar}} AS cigar, seq, CASE WHEN rec_no % 3 > 0 THEN repeat('1E', length(seq)) END AS qual, zmw::BIGINT AS zm FROM whole"


def _shown(reads: DataFrame) -> DataFrame:
    return reads.select(
        "qname",
        "flag",
        "rname",
        "pos",
        F.col("mapq").cast("int").alias("mapq"),
        C.format_cigar(F.col("cigar")).alias("cigar"),
        "seq",
        F.hex("qual").alias("qual"),
        F.col("tags")["zm"]["i"].alias("zm"),
    )


@register(_RECORD_SQL.format(cigar="cigar_text"))
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.sources import bam

    path = f"{_folder(spark)}/reads.bam"
    bam.write_bam(full_reads(spark, sf_dir), path, _header(spark, sf_dir), compression=1)
    return _shown(bam.read_bam(spark, path))


@register(_RECORD_SQL.format(cigar="cigar_text"))
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.sources import sam

    path = f"{_folder(spark)}/reads.sam"
    sam.write_sam(full_reads(spark, sf_dir), path, _header(spark, sf_dir))
    return _shown(sam.read_sam(spark, path))


#: CRAM gives M for = and X, and merges neighbours: nS(k+5)=1X becomes nS(k+6)M. Unmapped records have no mapping quality.
_M_CIGAR = """CASE WHEN ref_id < 0 THEN '*' ELSE regexp_extract(cigar_text, '^([0-9]+S)', 1) || (CAST(regexp_extract(cigar_text, 'S([0-9]+)=', 1) AS INT) + 1) || 'M'
  || regexp_extract(cigar_text, 'X(.*)$', 1) END"""


@register(_RECORD_SQL.format(cigar=_M_CIGAR).replace("mapq::INT AS mapq", "CASE WHEN (flag & 4) = 0 THEN mapq ELSE 0 END::INT AS mapq"))
def cram_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.sources import cram

    path = f"{_folder(spark)}/reads.cram"
    cram.write_cram(full_reads(spark, sf_dir), path, _header(spark, sf_dir))
    return _shown(cram.read_cram(spark, path))


@register(
    f"""{_FULL_SQL}, win AS (SELECT *, mapq % 5 AS a, length(seq) - zmw % 3 AS b FROM whole)
SELECT rec_no, substr(seq, CASE WHEN (flag & 16) <> 0 THEN length(seq) - b ELSE a END::INT + 1, (b - a)::INT) AS seq, (b - a)::BIGINT AS ip_count FROM win"""
)
def clip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full_reads(spark, sf_dir).withColumns({"clip_start": (F.col("mapq") % 5).cast("int"), "clip_end": (F.length("seq") - F.col("tags")["zm"]["i"] % 3).cast("int")})
    return clip.clip(rows, "query", only=["ip"]).select("rec_no", "seq", F.size(F.col("tags")["ip"]["ai"]).cast("bigint").alias("ip_count"))


@register(
    f"""{_FULL_SQL} SELECT rec_no, (CASE WHEN ref_id < 0 THEN pos ELSE pos + 3 END)::INT AS pos, (CASE WHEN ref_id < 0 THEN 0 ELSE ref_len - 5 END)::BIGINT AS ref_len FROM whole"""
)
def clip_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = C.reference_end(F.col("pos"), F.col("cigar"))
    rows = full_reads(spark, sf_dir).withColumns({"clip_start": F.col("pos") + 3, "clip_end": (end - 2).cast("int")})
    return clip.clip(rows, "reference").select("rec_no", "pos", C.reference_length(F.col("cigar")).alias("ref_len"))


@register(_RECORD_SQL.format(cigar=_M_CIGAR).replace("mapq::INT AS mapq", "CASE WHEN (flag & 4) = 0 THEN mapq ELSE 0 END::INT AS mapq"))
def cram31_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cram_round_trip with blocks of rANS Nx16."""
    from readloom.sources import cram

    path = f"{_folder(spark)}/reads.cram"
    cram.write_cram(full_reads(spark, sf_dir), path, _header(spark, sf_dir), methods="5")
    return _shown(cram.read_cram(spark, path))


def _value(like, code: str, **parts):
    """A tag's value of the type code, with only the given parts set."""
    value = like.withField("t", F.lit(code)).withField("i", F.lit(None).cast("bigint")).withField("et", F.lit("C" if code == "B" else None).cast("string"))
    for name, part in parts.items():
        value = value.withField(name, part)
    return value


def tagged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """full_reads with more per-base tags: a mirrored track, pulses, coverage runs, barcodes, and tags that state lengths."""
    rows = full_reads(spark, sf_dir)
    like, n = F.col("tags")["zm"], F.length("seq")

    def track(size, factor: int, modulus: int):
        return _value(like, "B", ai=_multiples(size, factor, modulus))

    half = (n / 2).cast("bigint")
    more = {
        "ri": track(n, 11, 241),
        "pc": _value(like, "Z", s=F.substring(F.lit("".join(c + "a" for c in _PATTERN * 10)), F.lit(1), 2 * n)),
        "pd": track(2 * n, 3, 249),
        "sa": _value(like, "B", ai=F.array(half, F.lit(7).cast("bigint"), n - half, F.lit(9).cast("bigint"))),
        "MN": _value(like, "i", i=n.cast("bigint")),
        "qs": _value(like, "i", i=F.lit(0).cast("bigint")),
        "qe": _value(like, "i", i=n.cast("bigint")),
        "bc": _value(like, "B", et=F.lit("S"), ai=F.array(F.when(like["i"] % 4 == 0, 65535).otherwise(like["i"] % 8), like["i"] % 5)),
    }
    return rows.withColumn("tags", F.map_concat("tags", F.create_map(*(x for k, v in more.items() for x in (F.lit(k), v)))))


def _windowed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"clip_start": (F.col("mapq") % 5).cast("int"), "clip_end": (F.length("seq") - F.col("tags")["zm"]["i"] % 3).cast("int")})


#: a and b: the window of the query; o: where it begins in the stored sequence of n bases; l: its length.
_WIN_SQL = f"""{_FULL_SQL}, win0 AS (SELECT *, (mapq % 5)::BIGINT AS a, (length(seq) - zmw % 3)::BIGINT AS b, length(seq)::BIGINT AS n FROM whole),
win AS (SELECT *, CASE WHEN (flag & 16) <> 0 THEN n - b ELSE a END AS o, b - a AS l, n // 2 AS half FROM win0)"""


@register(
    f"""{_WIN_SQL} SELECT rec_no, substr(seq, o::INT + 1, l::INT) AS seq,
  CASE WHEN rec_no % 3 > 0 THEN repeat('1E', l::INT) END AS qual,
  list_sum(list_transform(range(o + 1, o + l + 1), lambda i: i * 7 % 251))::BIGINT AS ip_sum,
  list_sum(list_transform(range(n - o - l + 1, n - o + 1), lambda i: i * 11 % 241))::BIGINT AS ri_sum,
  (2 * l - 1)::BIGINT AS pd_n, list_sum(list_transform(range(2 * o + 1, 2 * (o + l)), lambda i: i * 3 % 249))::BIGINT AS pd_sum,
  CASE WHEN o < half THEN least(half, o + l) - o || ',7' ELSE '' END || CASE WHEN o < half AND o + l > half THEN ',' ELSE '' END
    || CASE WHEN o + l > half THEN o + l - greatest(half, o) || ',9' ELSE '' END AS sa,
  l AS mn, a AS qs, b AS qe FROM win"""
)
def clip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.col("tags")

    def total(key: str):
        return F.aggregate(tag[key]["ai"], F.lit(0).cast("bigint"), lambda a, x: a + x)

    return clip.clip(_windowed(tagged_reads(spark, sf_dir)), "query", only=["ip", "ri", "pd", "sa", "MN", "qs", "qe"]).select(
        "rec_no",
        "seq",
        F.hex("qual").alias("qual"),
        total("ip").alias("ip_sum"),
        total("ri").alias("ri_sum"),
        F.size(tag["pd"]["ai"]).cast("bigint").alias("pd_n"),
        total("pd").alias("pd_sum"),
        F.array_join(tag["sa"]["ai"].cast("array<string>"), ",").alias("sa"),
        tag["MN"]["i"].alias("mn"),
        tag["qs"]["i"].alias("qs"),
        tag["qe"]["i"].alias("qe"),
    )


@register(
    f"""{_WIN_SQL} SELECT rec_no, substr(seq, a::INT + 1, l::INT) AS clipped, l < n AS marked,
  seq, CASE WHEN rec_no % 3 > 0 THEN repeat('1E', length(seq)) END AS qual, n AS ip_count,
  list_sum(list_transform(range(1, n + 1), lambda i: i * 7 % 251))::BIGINT AS ip_sum FROM win"""
)
def lossless_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads clipped without loss, as they are then and after they are restored."""
    rows = full_reads(spark, sf_dir)
    cut = lossless.clip_reads(_windowed(rows)).withColumns({"clipped": F.col("seq"), "marked": F.array_contains(F.map_keys("tags"), "ls")})
    back = lossless.restore_reads(cut)
    track = F.col("tags")["ip"]["ai"]
    return back.select(
        "rec_no", "clipped", "marked", "seq", F.hex("qual").alias("qual"), F.size(track).cast("bigint").alias("ip_count"), F.aggregate(track, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ip_sum")
    )


@register(f"{_FULL_SQL} SELECT rec_no, 'ip' AS key, length(seq)::BIGINT AS n, list_sum(list_transform(range(1, length(seq) + 1), lambda i: i * 7 % 251))::BIGINT AS total FROM whole")
def tag_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.functions.tags import drop_tags

    left = full_reads(spark, sf_dir).select("rec_no", F.explode(drop_tags(F.col("tags"), ["zm"])).alias("key", "value"))
    return left.select("rec_no", "key", F.size("value.ai").cast("bigint").alias("n"), F.aggregate("value.ai", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@register(f"""{_FULL_SQL}, k AS (SELECT *, unnest(['MN', 'zm']) AS key FROM whole)
SELECT rec_no, 9::BIGINT AS left_over, key, CASE WHEN key = 'zm' THEN zmw ELSE length(seq) END::BIGINT AS value FROM k""")
def tag_keep_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the reads without their kinetics (ip, ri), counted, and of those the kept ones with their values."""
    from readloom.functions.tags import keep_tags, strip_kinetics

    rows = tagged_reads(spark, sf_dir).withColumn("tags", strip_kinetics(F.col("tags")))
    rows = rows.withColumn("left_over", F.size("tags").cast("bigint") + 1)
    return rows.select("rec_no", "left_over", F.explode(keep_tags(F.col("tags"), ["zm", "MN"])).alias("key", "value")).select("rec_no", "left_over", "key", F.col("value.i").alias("value"))


@register(f"{_FULL_SQL} SELECT rec_no, CASE WHEN zmw % 4 = 0 THEN -1 ELSE zmw % 8 END::INT AS fwd, (zmw % 5)::INT AS rev, zmw::BIGINT AS ws FROM whole")
def barcode_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The barcode pair of each read's tag bc, and a typed accessor."""
    from readloom.functions.tags import barcodes, movie_frames

    pair = barcodes(F.col("tags"))
    return tagged_reads(spark, sf_dir).select("rec_no", pair["fwd"].alias("fwd"), pair["rev"].alias("rev"), movie_frames(F.col("tags"), "zm").alias("ws"))


@register(f"{_FULL_SQL} SELECT (rec_no % 2)::INT AS file_ord, rname, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM whole GROUP BY 1, 2")
def multi_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two BAM files read as one relation, in list order."""
    from readloom.sources import bam

    folder, header, rows = _folder(spark), _header(spark, sf_dir), full_reads(spark, sf_dir)
    paths = [f"{folder}/{i}.bam" for i in (0, 1)]
    for i, path in enumerate(paths):
        bam.write_bam(rows.where(F.col("rec_no") % 2 == i), path, header, compression=1)
    return bam.read_bam(spark, paths).groupBy("file_ord", "rname").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@register(f"{_FULL_SQL}, o AS (SELECT *, CASE WHEN ref_id < 0 THEN 99 ELSE ref_id END AS k, ref_id % 3 AS part FROM whole WHERE ref_id BETWEEN 0 AND 8)\nSELECT row_number() OVER (ORDER BY k // 3, k, pos, (flag & 16) <> 0, rec_no)::BIGINT AS ord, qname, pos FROM o")
def merge_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted BAM files whose ranges follow each other, given out of order, merged without an exchange."""
    from readloom.functions.ordinals import number_in_place
    from readloom.sources import bam

    folder, header, rows = _folder(spark), _header(spark, sf_dir), full_reads(spark, sf_dir).where("ref_id between 0 and 8")
    paths = [f"{folder}/{i}.bam" for i in (2, 0, 1)]
    for path in paths:
        part = int(path[-5])
        bam.write_bam(sort.sort_coordinate(rows.where(F.expr("ref_id div 3") == part)), path, header, compression=1)
    merged = sort.merge_chain([bam.read_bam(spark, p) for p in paths])
    if merged is None:
        raise ValueError("the inputs are not a chain")
    return number_in_place(merged.select("qname", "pos"), "ord")


@register(
    f"""{_FULL_SQL} SELECT rec_no, zmw::INT AS zmw, 0 AS none, 'a1b2c3d4' AS rg, md5(upper(seq)) AS md5, substr(seq, (rec_no % 8)::INT + 1, 1) AS base FROM whole"""
)
def name_and_sequence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.functions import names as N
    from readloom.functions import sequence as SQ

    group = F.concat(F.lit("a1b2c3d4/"), F.col("rec_no").cast("string"))
    return full_reads(spark, sf_dir).select(
        "rec_no",
        N.zmw_or_zero(F.col("qname")).alias("zmw"),
        N.zmw_or_zero(F.concat(F.lit("x"), F.substring_index("qname", "/", 1))).alias("none"),
        N.read_group_base(group).alias("rg"),
        SQ.reference_md5(F.lower("seq")).alias("md5"),
        SQ.base_at(F.col("seq"), (F.col("rec_no") % 8).cast("int")).alias("base"),
    )


@register(
    f"""WITH s AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents),
p AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 19)) AS i0 FROM s),
k AS (SELECT doc_id, i0, seq, unnest(range(0, 20)) AS k FROM p),
h AS (SELECT doc_id, i0, xor(sum((strpos('ACGT', substr(seq, (i0 + k + 1)::INT, 1)) - 1)::HUGEINT << (2 * (19 - k))::INT)::BIGINT, {sort.FLIP & sort.MASK}::BIGINT) AS h FROM k GROUP BY doc_id, i0),
m AS (SELECT doc_id, min(h) AS h, arg_min(i0, (h, i0)) AS i0 FROM h GROUP BY doc_id)
SELECT s.doc_id, coalesce(h + 1073741824, 1073741823)::BIGINT AS hash, CASE WHEN h IS NULL THEN 65554 ELSE greatest(65535 - i0, 0) END::INT AS place FROM s LEFT JOIN m USING (doc_id)"""
)
def minimiser_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustering key of unplaced reads, over the letters A, C, G and T of the documents."""
    seq = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "")
    key = sort.minimiser_key(seq)
    return D.table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).select("doc_id", "key.hash", "key.place")
