"""Keyed state: upserts, no-ops, changed fields and partial refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; max_by combines map-side, so no key's history is gathered."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*")


def changes(log: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """log with is_noop: whether the row leaves its key's fields as they were."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = None
    for f in fields:
        one = F.col(f).eqNullSafe(F.lag(f).over(w))
        same = one if same is None else same & one
    first = F.lag(F.lit(1)).over(w).isNull()
    return log.withColumn("is_noop", ~first & same)


def field_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(*keys, change, changed_fields): added, removed, changed or same, from a full outer join."""
    o = old.select(*keys, F.struct(*fields).alias("__o"))
    n = new.select(*keys, F.struct(*fields).alias("__n"))
    j = o.join(n, keys, "full")
    diff = F.array_compact(F.array(*[F.when(~F.col(f"__o.{f}").eqNullSafe(F.col(f"__n.{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.size(diff) > 0, "changed").otherwise("same")
    return j.select(*keys, kind.alias("change"), diff.alias("changed_fields"))


def refreshed(kept: DataFrame, recomputed: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """kept, with the affected keys' rows replaced by the recomputed ones."""
    return kept.join(affected.select(*keys).distinct(), keys, "left_anti").unionByName(recomputed)
