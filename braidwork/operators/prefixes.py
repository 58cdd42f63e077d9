"""The nearest known ancestor of a path: a longest-prefix join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: str) -> Column:
    """(dir, depth) of a path's directories, the root '' at depth 0."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("dir"), k.alias("depth")))


def nearest(paths: DataFrame, known: DataFrame, path: str, root: str, keys: list[str] | None = None) -> DataFrame:
    """paths with the deepest ``root`` of known that is one of its directories, null where none is.

    Directories are exploded, so the join is an equi-join and the deepest is a partial maximum; a path has
    few directories, however many roots are known. Of equal roots the greatest row counts.
    """
    keys = keys or []
    tagged = paths.withColumn("__id", F.monotonically_increasing_id())
    up = tagged.select("__id", *keys, F.explode(ancestors(path)).alias("a")).select("__id", *keys, F.col("a.dir").alias(root), F.col("a.depth").alias("__depth"))
    rest = [c for c in known.columns if c not in keys]
    hit = up.join(known, [*keys, root]).groupBy("__id").agg(F.max_by(F.struct(*rest), F.struct("__depth", *rest)).alias("__known"))
    return tagged.join(hit, "__id", "left").select(*paths.columns, *[F.col(f"__known.{c}").alias(c) for c in rest])
