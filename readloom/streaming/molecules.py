"""Streams of reads: molecule groups and incremental index parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators import index as I

GAP = "30 seconds"


def molecule_groups(reads: DataFrame, time: str = "ts", gap: str = GAP, delay: str = "1 minute") -> DataFrame:
    """Groups of a stream's records of one molecule: rg_id, zmw, begin, end, records (rec_no, qname) in order.

    A group is a session of its identity: it closes when none of its records came for gap, and is emitted once
    the watermark has passed that. Sessions are merged by Spark's own state store, so a molecule's records may
    arrive in any order and in several batches. On a batch input the same groups come out at once.
    """
    windowed = reads.withWatermark(time, delay).groupBy("rg_id", "zmw", F.session_window(time, gap).alias("s"))
    groups = windowed.agg(F.sort_array(F.collect_list(F.struct("rec_no", "qname"))).alias("records"))
    return groups.select("rg_id", "zmw", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "records")


def molecule_counts(reads: DataFrame, time: str = "ts", window: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """Records and bases of each read group and tumbling window."""
    return (
        reads.withWatermark(time, delay)
        .groupBy("rg_id", F.window(time, window).alias("w"))
        .agg(F.count("*").alias("records"), F.sum("qlen").cast("bigint").alias("bases"))
        .select("rg_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "records", "bases")
    )


class IndexBuilder:
    """Builds BAI parts while a file is written: each batch of records adds its bins, windows and counts.

    A batch's parts replace those of the same batch number, so a batch that is run again after a failure
    changes nothing. Reads need ref_id, pos, flag, cigar, voffset and end_voffset.
    """

    PARTS = ("bins", "linear", "meta", "unplaced")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, batch: DataFrame, number: int) -> None:
        parts = {"bins": I.bai_bins(batch), "linear": I.bai_linear(batch), "meta": I.bai_meta(batch), "unplaced": I.no_coordinate_count(batch)}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def start(self, reads: DataFrame, checkpoint: str) -> StreamingQuery:
        return reads.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("batch")

    def bins(self) -> DataFrame:
        return I.coalesce_ranges(self.part("bins"), ["ref_id", "bin"])

    def linear(self) -> DataFrame:
        return self.part("linear").groupBy("ref_id", "win").agg(F.min("voffset").alias("voffset"))

    def meta(self) -> DataFrame:
        return (
            self.part("meta")
            .groupBy("ref_id")
            .agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.sum("n_mapped").alias("n_mapped"), F.sum("n_unmapped").alias("n_unmapped"))
        )

    def unplaced(self) -> int:
        return self.part("unplaced").agg(F.coalesce(F.sum("n_no_coor"), F.lit(0))).first()[0]
