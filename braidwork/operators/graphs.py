"""Closures over edges with a visited set; graphs may have cycles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

#: Edges and roots that one task may hold, some 200 bytes each; larger graphs are walked by rounds of joins.
SMALL = 1 << 18


def _in_one_task(edges: DataFrame, roots: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """reachable of a graph of at most SMALL rows: a walk in breadth, however deep the graph is."""
    schema = roots.select(*keys, "node", F.lit(0).alias("depth")).schema
    blank = lambda names, of: [F.lit(None).cast(of.schema[c].dataType).alias(c) for c in names]
    rows = edges.select(*shared, "src", "dst", *blank([k for k in keys if k not in shared], roots), F.lit(False).alias("root"))
    rows = rows.unionByName(roots.select(*keys, F.col("node").cast(edges.schema["src"].dataType).alias("src"), *blank(["dst"], edges), F.lit(True).alias("root")))

    def run(batches):
        after: dict[tuple, list] = {}
        here: set[tuple] = set()
        for batch in batches:
            for r in batch.to_pylist():
                if r["root"]:
                    here.add((*(r[k] for k in keys), r["src"]))
                else:
                    after.setdefault((*(r[k] for k in shared), r["src"]), []).append(r["dst"])
        places = [keys.index(k) for k in shared]
        seen, depth, out = set(here), 0, []
        while here:
            out += [(*state, depth) for state in here]
            here = {(*state[:-1], dst) for state in here for dst in after.get((*(state[i] for i in places), state[-1]), ())} - seen
            seen |= here
            depth += 1
        cols = list(zip(*out, strict=True)) or [()] * len(arrow)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return rows.coalesce(1).mapInArrow(run, schema)


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str] | None = None, tag: str = "reached", allow: Column | None = None) -> DataFrame:
    """(*keys, node, depth): what can be reached from roots (*keys, node) along edges (*edge keys, src, dst).

    Semi-naive: each round joins only the last round's nodes, and what is visited is taken out by an
    anti-join. Edges may carry a subset of ``keys``; those are joined too. ``allow`` is a condition on a step,
    over keys and the edge's columns. A graph of at most SMALL edges and roots is walked in one task, as its depth would
    cost a round of joins each. Every round's nodes
    are a table in the shared folder, so lineage doesn't grow and no node comes to the driver.
    """
    keys = keys or []
    shared = [k for k in keys if k in edges.columns]
    if allow is None and edges.count() + roots.count() <= SMALL:
        return written(_in_one_task(edges, roots, keys, shared), tag)
    frontier = written(roots.select(*keys, "node").distinct().withColumn("depth", F.lit(0)), tag)
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.drop("depth").withColumnRenamed("node", "src").join(edges, [*shared, "src"]).where(F.lit(True) if allow is None else allow).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)), tag)
        seen = seen.unionByName(frontier)
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "__s", "dst": "src"}).withColumnRenamed("__s", "dst")


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The nodes that no root reaches."""
    return nodes.join(reachable(edges, roots, keys).select(*(keys or []), "node"), [*(keys or []), "node"], "left_anti")


def affected(old: DataFrame, new: DataFrame, changed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The nodes whose dependencies, before or after, include a changed one."""
    both = old.unionByName(new).distinct()
    return reachable(reversed_edges(both), changed, keys)
