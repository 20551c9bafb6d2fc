"""Cuts of lineage in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is taken only where it is unset (tests)."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    if not held.isDefined():
        sc.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of df in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
