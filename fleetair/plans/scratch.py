"""Where intermediate tables and streaming checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that every executor sees (``spark.checkpoint.dir``)."""
    return f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where driver and executors are one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(
            f"spark.checkpoint.dir is not set: executors of {master} need a folder they share")
    return tempfile.mkdtemp(prefix="fleetair-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a table that is about to be read many times.

    Later jobs start from the files, also after executors are lost.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
