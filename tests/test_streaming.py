from __future__ import annotations

import random

from braidwork.streaming import keyed_state

SCHEMA = "path string, gen long, op string, source string"


def test_stream_equals_rebuild(spark, tmp_path):
    rng = random.Random(4)
    log = [(f"f{rng.randrange(12)}", g, rng.choice(["upsert", "upsert", "upsert", "remove"]), f"s{rng.randrange(5)}") for g in range(120)]
    late = log[:]
    rng.shuffle(late)  # rows come in any order
    inbox, store, marks = (str(tmp_path / n) for n in ("in", "state", "marks"))
    for k in range(0, 120, 40):
        spark.createDataFrame(late[k : k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        q = keyed_state.start(stream, store, ["path"], "gen", marks, availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None
    want = {}
    for path, gen, op, source in log:
        want[path] = (gen, op, source)
    got = {r.path: (r.gen, r.source) for r in keyed_state.snapshot(spark, store).collect()}
    assert got == {p: (g, s) for p, (g, op, s) in want.items() if op != "remove"}
    assert keyed_state.changed_between(spark, store, 0, 99, ["path"], ["source"]).count() > 0


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "state")
    apply = keyed_state.applied(store, ["path"], "gen")
    first = spark.createDataFrame([("a", 1, "upsert", "x"), ("b", 2, "upsert", "y")], SCHEMA)
    second = spark.createDataFrame([("a", 3, "remove", None), ("b", 1, "upsert", "old")], SCHEMA)
    apply(first, 0)
    for _ in range(2):
        apply(second, 1)
        assert [(r.path, r.source) for r in keyed_state.snapshot(spark, store).collect()] == [("b", "y")]
    assert keyed_state.snapshot(spark, store, 0).count() == 2
