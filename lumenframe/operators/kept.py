"""Tables between the rounds of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in a temporary one only where none is set (tests on one machine)."""
    context = spark.sparkContext
    if not (root := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
