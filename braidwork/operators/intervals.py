"""Points in intervals, and the innermost interval of each point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """points joined with the intervals of equal keys that contain them, lo <= at < hi.

    An equi-join, also within one key: an interval of length up to 2^k lies in at most two cells of
    width 2^k, and a point looks into one cell for each k that occurs (at most 63, by the type). So a
    key with very many intervals is spread over its cells. Names besides the keys must differ.
    """
    width = F.col(hi) - F.col(lo)
    sized = intervals.where(width > 0).withColumn("__k", F.ceil(F.log2(width.cast("double"))).cast("int"))
    sized = sized.withColumn("__k", F.when(F.expr("shiftleft(1L, __k)") < width, F.col("__k") + 1).otherwise(F.col("__k")))
    cells = F.array_distinct(F.array(F.expr(f"shiftright(cast(`{lo}` as bigint), __k)"), F.expr(f"shiftright(cast(`{hi}` as bigint) - 1, __k)")))
    right = sized.withColumn("__cell", F.explode(cells))
    kinds = sized.select("__k").distinct()  # one row for each power of two
    left = points.join(F.broadcast(kinds)).withColumn("__cell", F.expr(f"shiftright(cast(`{at}` as bigint), __k)"))
    on = [*keys, "__k", "__cell"]
    return left.join(right, on).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__k", "__cell")


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], point_id: list[str], at: str, lo: str, hi: str, ties: list[Column | str] | None = None) -> DataFrame:
    """Each contained point with its shortest interval, then the latest start, then ``ties`` (ascending).

    ``n_best`` counts the intervals that share the best (length, start): more than one is ambiguous.
    Combines in partial aggregates, so that no point's intervals are gathered.
    """
    found = containing(points, intervals, keys, at, lo, hi)
    rest = [c for c in intervals.columns if c not in keys]
    length, start = (F.col(hi) - F.col(lo)).alias("length"), (-F.col(lo)).alias("start")
    order = F.struct(length, start, *[F.col(t) if isinstance(t, str) else t for t in (ties or rest)])
    own = [c for c in points.columns if c not in point_id]
    best = found.groupBy(*point_id).agg(*[F.any_value(c).alias(c) for c in own], F.min(F.struct(length, start)).alias("__least"), F.min_by(F.struct(*rest), order).alias("__best"))
    same = found.select(*point_id, F.struct(length, start).alias("__rank")).groupBy(*point_id, "__rank").count().groupBy(*point_id).agg(F.min_by("count", "__rank").alias("n_best"))
    return best.join(same, point_id).select(*points.columns, *[F.col(f"__best.{c}").alias(c) for c in rest], "n_best")
