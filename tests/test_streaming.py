import json

from pyspark.sql import functions as F

from readloom.functions.cigar import parse_cigar
from readloom.operators import index
from readloom.streaming.molecules import IndexBuilder, molecule_counts, molecule_groups
from readloom.streaming.status import StatusLines


def timed(spark, n=200):
    row = spark.range(n).select(
        F.col("id").alias("rec_no"),
        F.concat(F.lit("m/"), F.expr("id div 4"), F.lit("/x")).alias("qname"),
        F.lit(1).alias("rg_id"),
        F.expr("cast(id div 4 as int)").alias("zmw"),
        F.lit(10).alias("qlen"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 5).alias("ts"),
    )
    return row


def stream(spark, tmp_path, df, parts=4):
    path = f"{tmp_path}/in"
    for k in range(parts):
        df.where(F.col("rec_no") % parts == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_molecule_groups_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = timed(spark)
    want = {(r["zmw"], tuple(x["rec_no"] for x in r["records"])) for r in molecule_groups(rows).collect()}
    assert want == {(z, tuple(range(4 * z, 4 * z + 4))) for z in range(50)}
    late = rows.limit(1).withColumns({"ts": F.timestamp_seconds(F.lit(1_700_900_000)), "zmw": F.lit(-1), "rec_no": F.lit(4003).cast("bigint")})
    got = run(molecule_groups(stream(spark, tmp_path, rows.unionByName(late)), delay="2 hours"), "groups")
    found = {(r["zmw"], tuple(x["rec_no"] for x in r["records"])) for r in got.collect()}
    assert want <= found


def test_tumbling_counts(spark, tmp_path):
    got = run(molecule_counts(stream(spark, tmp_path, timed(spark)), delay="2 hours"), "counts", "complete").collect()
    assert sum(r["records"] for r in got) == 200 and sum(r["bases"] for r in got) == 2000


def test_incremental_index_equals_the_batch_index(spark, tmp_path):
    rows = spark.range(500).select(
        F.col("id").alias("rec_no"),
        F.when(F.col("id") < 480, F.expr("cast(id div 240 as int)")).otherwise(-1).alias("ref_id"),
        F.when(F.col("id") < 480, ((F.col("id") % 240) * 400).cast("int")).otherwise(-1).alias("pos"),
        F.when(F.col("id") % 7 == 0, 4).otherwise(0).alias("flag"),
        parse_cigar(F.lit("50M")).alias("cigar"),
        (F.col("id") * 100).alias("voffset"),
        (F.col("id") * 100 + 100).alias("end_voffset"),
    )
    builder = IndexBuilder(spark, f"{tmp_path}/index")
    builder.start(stream(spark, tmp_path, rows), f"{tmp_path}/checkpoint").awaitTermination(180)
    builder.add(rows.where("rec_no % 4 = 0"), 0)  # a batch that is run again
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(builder.bins(), index.bai_bins(rows)) and same(builder.linear(), index.bai_linear(rows))
    assert same(builder.meta(), index.bai_meta(rows)) and builder.unplaced() == 20


def test_status_lines(tmp_path):
    path = f"{tmp_path}/s.jsonl"
    with StatusLines(path, "depth", cadence=0, input="x") as s:
        s.phase("count")
        assert s.progress(records=1) and not s.progress(records=1) and s.progress(records=2)
        s.final(records=2)
    events = [json.loads(line) for line in open(path)]
    assert [e["event"] for e in events] == ["run_info", "phase", "progress", "progress", "final"] and events[-1]["metrics"] == {"records": 2}
