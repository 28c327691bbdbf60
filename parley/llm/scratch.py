"""Cutting lineage: intermediate results go to the folder that the cluster names, where lost executors can't take them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset on a single machine (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: what is written between steps must outlive an executor")
        if not named:
            named = os.path.join(tempfile.gettempdir(), "parley-checkpoints")
            context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept by ``checkpoint()``. Spark's cleaner removes the files after the last use only where
    the application was started with ``spark.cleaner.referenceTracking.cleanCheckpoints=true``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for results that are read by column or are large."""
    path = f"{shared_dir(df.sparkSession)}/parley/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
