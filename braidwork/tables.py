"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where none is set (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    own = os.path.join(tempfile.gettempdir(), "braidwork-checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braidwork/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
