"""Cutting lineage in shared storage."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's spark.checkpoint.dir (one of our own only where that is unset and Spark is local) and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Drop what nothing refers to any more, here and in the driver's JVM, whose heap shrinks with it; its shuffle and checkpoint files go, too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
