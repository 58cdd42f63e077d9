"""Resolution by tiers: the first tier with a candidate decides, and does not fall through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_tier(queries: DataFrame, candidates: DataFrame, keys: list[str], tier: str, candidate: str, missing: Column | str = "missing") -> DataFrame:
    """queries with tier, n_candidates, candidate (the least of a sole one's kind) and status.

    Candidates are counted by (query, tier) in partial aggregates; the first tier is a minimum over those
    counts, so a query with very many candidates is never gathered.
    """
    counted = candidates.groupBy(*keys, tier).agg(F.countDistinct(candidate).alias("n"), F.min(candidate).alias(candidate))
    best = counted.groupBy(*keys).agg(F.min(F.struct(tier, "n", candidate)).alias("b"))
    out = queries.join(best, keys, "left")
    none = F.lit(missing) if isinstance(missing, str) else missing
    status = F.when(F.col("b").isNull(), none).when(F.col("b.n") == 1, "resolved").otherwise("ambiguous")
    return out.select(*queries.columns, F.col(f"b.{tier}").alias(tier), F.coalesce("b.n", F.lit(0)).alias("n_candidates"), F.when(F.col("b.n") == 1, F.col(f"b.{candidate}")).alias(candidate), status.alias("status"))
