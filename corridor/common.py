"""Session-wide helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder; a folder of our own only in local mode, where none is set."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for tables that a query writes and reads again."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


class Refused(ValueError):
    """Input or result that a gate does not let through."""
