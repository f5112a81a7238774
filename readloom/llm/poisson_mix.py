"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with n rows and target weight w gets the mean repetition rate budget * w / n.
Each row's number of copies inverts the Poisson distribution function at a uniform
number hashed from its id, its text and the seed; rates over ``RATE_STEP`` are sums of Poisson
numbers of smaller rate, so the distribution table of a source stays short. Rows are
exploded by their number and exchanged by a hash of (id, text, copy), which also orders each
partition: a uniform global shuffle that needs no sampling pass and is reproducible.

The table of sources is one row per source; it is broadcast if it has few rows and
otherwise joined on (source, salt), with each source's rows dealt over the salts.

Defined cases: null sources are one source of their own; a source without a target
weight gets none and its rows go; null ids and texts hash as empty ones; rows that tie in id and text get
the same number of copies; texts of any length hash whole; an empty table gives an empty result; all columns of the
input are kept, and those named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import BROADCAST_ROWS, materialize

SEED, RATE_STEP, SALTS = 17, 32.0, 32
#: Exponent of a source's row count in its default target weight: 1 keeps the shares, 0 makes all equal.
TEMPERATURE = 0.5


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_table(rate: str) -> Column:
    """The distribution function of a Poisson variable at 0, 1, ..., until it is 1 up to rounding."""
    last = f"cast(ceil({rate} + 10 * sqrt({rate}) + 30) as int)"
    return F.expr(
        f"""aggregate(sequence(1, {last}), named_struct('f', 0D, 'c', array(exp(-{rate}))),
        (a, k) -> named_struct('f', a.f + ln(k), 'c', concat(a.c, array(element_at(a.c, -1) + exp(k * ln({rate}) - {rate} - (a.f + ln(k)))))),
        a -> a.c)"""
    )


def source_rates(docs: DataFrame, source_col: str, weights: DataFrame | None, budget: float | None, temperature: float) -> DataFrame:
    """mix_source, pieces and table of each source that has a positive rate; materialized."""
    sizes = docs.groupBy(F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        sized = sizes.withColumn("w", F.col("n").cast("double") ** F.lit(temperature) if temperature != 0.5 else F.sqrt(F.col("n").cast("double")))
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("mix_source"), F.col("weight").cast("double").alias("w"))
        sized = sizes.join(given, "mix_source")
    sized = materialize(sized.select("mix_source", "n", "w"), merge=True)
    totals = sized.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    rows = totals["n"] if weights is None else docs.count() if budget is None else 0
    wanted = float((rows or 0) if budget is None else budget)
    rates = sized.select("mix_source", (F.lit(wanted) * F.col("w") / F.lit(totals["w"] or 1.0) / F.col("n")).alias("rate")).where("rate > 0")
    pieces = rates.withColumn("pieces", F.ceil(F.col("rate") / RATE_STEP).cast("int")).withColumn("step", F.col("rate") / F.col("pieces"))
    return materialize(pieces.select("mix_source", "pieces", poisson_table("step").alias("table")), merge=True)


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    budget: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = SEED,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """docs with each row repeated by its Poisson number, shuffled; adds copy_no, n_copies, mix_key.

    weights: columns source_col and weight, relative target shares; without them a source's weight is
    its row count to the power of temperature. budget: expected rows of the result, by default those of docs.
    """
    docs = docs.drop("copy_no", "n_copies", "mix_key", "mix_source", "mix_name", "mix_salt")
    rates = source_rates(docs, source_col, weights, budget, temperature)
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    keyed = docs.withColumn("mix_source", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))).withColumn("mix_name", name)
    name = F.col("mix_name")
    if rates.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(rates), "mix_source")
    else:
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("mix_salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(salted, ["mix_source", "mix_salt"]).drop("mix_salt")
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("pieces")),
        F.lit(0),
        lambda n, i: n + F.size(F.filter(F.col("table"), lambda c: c <= uniform(F.lit(str(seed)), name, i.cast("string")))),
    )
    repeated = joined.withColumn("n_copies", copies.cast("bigint")).where("n_copies > 0").drop("mix_source", "pieces", "table")
    repeated = repeated.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed + 1)), name, F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("bigint")
    return repeated.withColumn("mix_key", key).drop("mix_name").repartition("mix_key").sortWithinPartitions("mix_key")


#: DuckDB form of mix_sources with the default parameters, over documents.
MIX_SQL = f"""
WITH sizes AS (
  SELECT coalesce('=' || source, '') AS mix_source, count(*) AS n FROM documents GROUP BY 1),
rates AS (
  SELECT mix_source, (sum(n) OVER ())::DOUBLE * sqrt(n::DOUBLE) / (sum(sqrt(n::DOUBLE)) OVER ()) / n AS rate FROM sizes),
pieces AS (
  SELECT mix_source, ceil(rate / {RATE_STEP})::INT AS pieces, rate / ceil(rate / {RATE_STEP}) AS step FROM rates WHERE rate > 0),
steps AS (
  SELECT mix_source, pieces, step, unnest(range(0, ceil(step + 10 * sqrt(step) + 30)::BIGINT + 1)) AS k FROM pieces),
logs AS (
  SELECT *, sum(CASE WHEN k = 0 THEN 0::DOUBLE ELSE ln(k::DOUBLE) END) OVER (PARTITION BY mix_source ORDER BY k) AS lf FROM steps),
tables AS (
  SELECT mix_source, pieces, k, sum(exp(k * ln(step) - step - lf)) OVER (PARTITION BY mix_source ORDER BY k) AS c FROM logs),
listed AS (
  SELECT mix_source, pieces, list(c ORDER BY k) AS cdf FROM tables GROUP BY 1, 2),
drawn AS (
  SELECT d.doc_id, d.source, d.text, coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, '')) AS name, t.cdf, unnest(range(1, t.pieces + 1)) AS i
  FROM documents d JOIN listed t ON coalesce('=' || d.source, '') = t.mix_source),
hashed AS (
  SELECT doc_id, source, text, name, cdf, ('0x' || substr(md5('{SEED}:' || name || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u FROM drawn),
counted AS (
  SELECT doc_id, source, text, name, sum(len(list_filter(cdf, lambda x: x <= u)))::BIGINT AS n_copies FROM hashed GROUP BY 1, 2, 3, 4),
copies AS (
  SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted)
SELECT doc_id, source, text, n_copies, copy_no::BIGINT AS copy_no,
  ('0x' || substr(md5('{SEED + 1}:' || name || ':' || copy_no::VARCHAR), 1, 15))::BIGINT AS mix_key
FROM copies
"""
