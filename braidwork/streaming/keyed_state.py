"""Keyed upserts and removals from a stream, kept as one immutable table for each generation.

A micro-batch makes the next generation: the last row of each key, of the one before and the batch. Its number is the
batch's, so a batch that is run again after a failure writes the same generation anew. Rows carry the caller's
order; a late row never replaces a newer one. Removed keys stay as tombstones, so that a late upsert does not bring them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state

UPSERT, REMOVE = "upsert", "remove"


def _generations(spark: SparkSession, path: str) -> list[int]:
    """The finished generations under path, by whatever file system it is on."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("generation=")]
    join = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(join(p, "_SUCCESS")))


def snapshot(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The state as of a generation, the last one by default, without removed keys."""
    known = [g for g in _generations(spark, path) if generation is None or g <= generation]
    if not known:
        raise ValueError(f"no generation under {path}")
    return spark.read.parquet(f"{path}/generation={known[-1]}").where(F.col("op") != REMOVE).drop("op")


def applied(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows have keys, order, op (upsert or remove) and values."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [g for g in _generations(spark, path) if g < number]
        rows = batch
        if before:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/generation={before[-1]}").unionByName(batch)
        state.latest(rows, keys, order).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/generation={number}")

    return apply


def changed_between(spark: SparkSession, path: str, old: int, new: int, keys: list[str], fields: list[str]) -> DataFrame:
    """What differs between two generations: (keys, change, changed_fields) without what is the same."""
    return state.field_diff(snapshot(spark, path, old), snapshot(spark, path, new), keys, fields).where("change <> 'same'")


def start(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, **trigger):
    """A running query that keeps path up to date with the stream."""
    return stream.writeStream.foreachBatch(applied(path, keys, order)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
