"""Cutting lineage in iterations, through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint; a local folder is set only on a local master that names none (tests)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """What is read more than once, as files of the shared folder; columns and codes keep them small."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="basalt-"))
        root = context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")
