"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side of a join may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path goes to Spark's reader unchanged, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor can reach.

    Only where the setting is absent (plain local tests) is a temporary folder made
    and set as the checkpoint folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/readloom-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the context, which is set if it isn't yet."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="readloom-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, merge: bool = False) -> DataFrame:
    """Reliable eager checkpoint: survives lost executors and fixes partition contents.

    merge: the table is narrow and comes from an exchange; its partitions are written by two tasks for each
    core, one partition after another, so that many small partitions do not become as many files.
    """
    sc = df.sparkSession.sparkContext
    checkpoint_dir(df.sparkSession)
    return (df.coalesce(2 * sc.defaultParallelism) if merge else df).checkpoint(eager=True)


def small_or_shuffled(side: DataFrame, rows: int | None = None) -> DataFrame:
    """side with a broadcast hint if it has at most BROADCAST_ROWS rows, else as it is.

    side must be cheap to count (materialized); the join is then a broadcast join or,
    beyond the bound, an ordinary shuffled join whose skew AQE splits.
    """
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= BROADCAST_ROWS else side.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get by bytes, for texts of one to a million characters."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
