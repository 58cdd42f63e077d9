"""Declared against used, duplicates, differences and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def use_counts(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """declared with how often each key is used; uses are counted before they are joined."""
    n = used.groupBy(*keys).agg(F.count("*").alias("use_count"))
    return declared.join(n, keys, "left").withColumn("use_count", F.coalesce("use_count", F.lit(0)))


def undeclared(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are used and not declared, with their number of uses."""
    return used.groupBy(*keys).agg(F.count("*").alias("use_count")).join(declared, keys, "left_anti")


def resolve_duplicates(rows: DataFrame, keys: list[str], content: str, row_id: str) -> DataFrame:
    """A row for each key: unique, identical (the smallest row_id is kept) or conflicting (none is kept)."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(content).alias("__lo"), F.max(content).alias("__hi"), F.min(row_id).alias("kept_id"))
    status = F.when(F.col("n_rows") == 1, "unique").when(F.col("__lo") == F.col("__hi"), "identical").otherwise("conflicting")
    return g.select(*keys, "n_rows", status.alias("status"), F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("kept_id")).alias("kept_id"))


def ordered_difference(a: Column | str, b: Column | str) -> Column:
    """The elements of a that b lacks, in their order, repeats too (array_except would drop those)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def fingerprint(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """An order-free 128-bit fingerprint of each group's rows, from sums of hashes: equal groups, equal fingerprints.

    Sums combine map-side; a group is never gathered or sorted.
    """
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), total(1).alias("fp1"), total(2).alias("fp2"))
