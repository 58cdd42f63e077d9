from __future__ import annotations

import random
from collections import Counter

from braidwork.plans import code, incremental

CONFIG = {
    "enabled_rules": ["forbidden_import", "layer_boundary", "naming_convention", "unresolved_part", "orphan_file"],
    "forbidden_imports": [{"pattern": "dart:io", "kind": "exact"}],
    "layer_boundaries": [{"source": "lib/a", "target": "lib/b"}],
    "orphan_files": {"entry_points": ["lib/a0.dart"]},
}


def state(spark, files):
    rows = [(p, "dart", path, s) for (p, path), s in files.items()]
    inputs = spark.createDataFrame(rows, "project_id string, kind string, path string, source string")
    facts = code.written(code.extracted(inputs), "facts")
    return facts, code.written(code.uri_edges(facts, inputs), "edges")


def found(df):
    return Counter((r.project_id, r.rule_id, r.severity, r.message, r.path, r.span, tuple(r.related_paths)) for r in df.collect())


def source(rng, path):
    out = []
    if path.startswith("lib/c"):
        out.append(f"part of 'a{rng.randrange(4)}.dart';")
    else:
        out += [f"import '{rng.choice('ab')}{rng.randrange(6)}.dart';" for _ in range(rng.randrange(3))]
        out += ["import 'dart:io';"] if rng.random() < 0.2 else []
        out += [f"part 'c{rng.randrange(3)}.dart';"] if rng.random() < 0.4 else []
    return "\n".join([*out, f"class {rng.choice(['Good', 'bad', 'Other'])} {{}}", f"// {rng.random()}"])


def test_updates_equal_a_full_rebuild(spark):
    rng = random.Random(11)
    names = [f"lib/{x}{k}.dart" for x, n in (("a", 6), ("b", 6), ("c", 3)) for k in range(n)]
    files = {(p, n): source(rng, n) for p in ("p", "q") for n in names if rng.random() < 0.8}
    old = state(spark, files)
    kept = code.written(code.lint(*old, CONFIG), "findings")
    fewer = 0
    for _ in range(4):
        files = dict(files)
        for _ in range(3):
            at = ("p", rng.choice(names))
            if at in files and rng.random() < 0.4:
                del files[at]
            else:
                files[at] = source(rng, at[1])
        new = state(spark, files)
        plan = incremental.rebuild_plan(old[0], new[0])
        paths = incremental.affected_paths(plan, old, new)
        own = incremental.affected_libraries(paths, incremental.libraries(*old), incremental.libraries(*new))
        assert own.where("project_id = 'q'").isEmpty()
        fewer += own.count() < new[0].where("project_id = 'p'").count()
        kept = code.written(incremental.lint_update(kept, own, old, new, CONFIG), "findings")
        assert found(kept) == found(code.lint(*new, CONFIG))
        old = new
    assert fewer


def test_rebuild_plan(spark):
    files = {("p", f"lib/f{k}.dart"): f"import 'x.dart';\nclass C{k} {{}}\n" for k in range(6)}
    new = dict(files)
    del new["p", "lib/f0.dart"]
    new["p", "lib/f1.dart"] += "class More {}\n"
    new["p", "lib/f2.dart"] = new["p", "lib/f2.dart"].replace("x.dart", "y.dart")
    new["p", "lib/f3.dart"] += "// nothing\n"
    new["p", "lib/f4.dart"] += "const k = 'v';\n"
    new["p", "lib/g.dart"] = ""
    a, b = state(spark, files), state(spark, new)
    got = {r.path: r for r in incremental.rebuild_plan(a[0], b[0]).collect()}
    assert set(got) == {"lib/f0.dart", "lib/f1.dart", "lib/f2.dart", "lib/f4.dart", "lib/g.dart"}
    flags = lambda p: [got[p][s] for s in incremental.SUBSYSTEMS]
    assert flags("lib/f0.dart") == flags("lib/g.dart") == [True] * 5
    assert flags("lib/f1.dart") == [True, False, False, True, True] and got["lib/f1.dart"].changed_fields == ["declarations"]
    assert flags("lib/f2.dart") == [True, True, False, True, True]
    names = spark.createDataFrame([("p", "lib/far.dart", "More"), ("p", "lib/off.dart", "C5"), ("q", "lib/far.dart", "More")], "project_id string, path string, name string")
    paths = {(r.project_id, r.path) for r in incremental.affected_paths(incremental.rebuild_plan(a[0], b[0]), a, b, names).collect()}
    assert ("p", "lib/far.dart") in paths and ("p", "lib/off.dart") not in paths and ("q", "lib/far.dart") not in paths
    assert incremental.rebuild_plan(a[0], a[0]).isEmpty()
