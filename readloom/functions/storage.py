"""Reliable intermediate storage in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def materialize(df: DataFrame) -> DataFrame:
    """An eager checkpoint: it survives lost executors and fixes the contents of partitions.

    Only where no checkpoint folder is set, as in plain local tests, a temporary one is made; on a cluster that is an error.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the context, which is set if it isn't yet."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="readloom-"))
    return sc.getCheckpointDir()
