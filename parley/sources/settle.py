"""Cutting lineage into the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; where it is unset on a single machine (tests), one of our own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: what is written between steps must outlive an executor")
    named = named or os.path.join(tempfile.gettempdir(), "parley-checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
