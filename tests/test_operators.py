from __future__ import annotations

import random

from pyspark.sql import functions as F

from braidwork.operators import audits, graphs, intervals, prefixes, state, tiers


def test_containing_equals_brute_force(spark):
    rng = random.Random(5)
    spans = [(k, rng.choice("ab"), a := rng.randrange(-300, 1000), a + rng.choice([0, 1, 2, 3, 64, 65, 127, 500])) for k in range(200)]
    points = [(k, rng.choice("ab"), rng.randrange(-320, 1300)) for k in range(300)]
    got = intervals.containing(spark.createDataFrame(points, "p long, g string, at long"), spark.createDataFrame(spans, "i long, g string, lo long, hi long"), ["g"], "at", "lo", "hi")
    want = {(p, i) for p, g, at in points for i, h, lo, hi in spans if g == h and lo <= at < hi}
    rows = got.select("p", "i").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_innermost_names_ties(spark):
    spans = spark.createDataFrame([("x", 0, 10), ("y", 2, 6), ("z", 2, 6), ("w", 7, 9)], "name string, lo long, hi long").withColumn("g", F.lit(1))
    points = spark.createDataFrame([(1, 3), (2, 8), (3, 9), (4, 20)], "p long, at long").withColumn("g", F.lit(1))
    got = {r.p: (r.name, r.n_best) for r in intervals.innermost(points, spans, ["g"], ["p"], "at", "lo", "hi", ["name"]).collect()}
    assert got == {1: ("y", 2), 2: ("w", 1), 3: ("x", 1)}


def test_nearest_ancestor(spark):
    paths = spark.createDataFrame([("a/b/c.dart",), ("a/x.dart",), ("q.dart",), ("b/c/d/e.dart",)], "path string")
    known = spark.createDataFrame([("", 0), ("a/b", 1), ("b/c", 2), ("b", 3)], "root string, id int")
    got = {r.path: r.id for r in prefixes.nearest(paths, known, "path", "root").collect()}
    assert got == {"a/b/c.dart": 1, "a/x.dart": 0, "q.dart": 0, "b/c/d/e.dart": 2}


def test_first_tier_does_not_fall_through(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    candidates = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 1, "d"), (2, 2, "e")], "q int, tier int, name string")
    got = {r.q: (r.status, r.name, r.n_candidates) for r in tiers.first_tier(queries, candidates, ["q"], "tier", "name").collect()}
    assert got == {1: ("ambiguous", None, 2), 2: ("resolved", "d", 1), 3: ("missing", None, 0)}


def test_closure_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (6, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "node long")
    roots = nodes.where("node = 1")
    assert {(r.node, r.depth) for r in graphs.reachable(edges, roots).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r.node for r in graphs.unreachable(nodes, edges, roots).collect()} == {5, 6}
    assert {r.node for r in graphs.affected(edges, edges.limit(0), nodes.where("node = 4")).collect()} == {1, 2, 3, 4}
    assert graphs.reachable(edges, roots.limit(0)).count() == 0


def test_duplicates_and_fingerprints(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 3), ("b", "y", 4), ("c", None, 5)], "path string, text string, id long")
    got = {r.path: (r.status, r.kept_id) for r in audits.resolve_duplicates(rows, ["path"], "text", "id").collect()}
    assert got == {"a": ("identical", 1), "b": ("conflicting", None), "c": ("unique", 5)}
    one, two = (audits.fingerprint(df, ["path"], ["text", "id"]) for df in (rows, rows.orderBy(F.desc("id"))))
    assert one.exceptAll(two).isEmpty()


def test_incremental_equals_rebuild(spark):
    rng = random.Random(9)
    log = spark.createDataFrame([(rng.randrange(20), k, rng.choice("abc")) for k in range(200)], "key long, gen long, value string")
    before, after = state.latest(log.where("gen < 150"), ["key"], "gen"), state.latest(log, ["key"], "gen")
    touched = log.where("gen >= 150").select("key").distinct()
    again = state.refreshed(before, after.join(touched, "key", "left_semi"), touched, ["key"])
    assert again.exceptAll(after).isEmpty() and after.exceptAll(again).isEmpty()
    diff = state.field_diff(before, after, ["key"], ["value"])
    assert diff.where("change = 'changed'").select("key").exceptAll(touched).isEmpty()
