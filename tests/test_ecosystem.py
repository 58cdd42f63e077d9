from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from braidwork.plans import assets, code, conventions, ecosystem

CASES = [
    ("^17.3.0", True), (">=14.0.0 <18.0.0", True), ("18.0.0", False), ("^18", False), (">=18.0.0", False), ("<14.0.0", False), ("<=14.0.0", True), (">17.9.9 <18.0.0", True),
    ("any", None), ("", None), ("1.0.0 || 14.0.0", None), ("path", None), ("v15.1", True), ("=16.0.0", True), ("=16.0.0 >16.0.0", False), (">=14.0.0, <15.0.0", True),
    (">=1.2.3.4", None), ("16.0.0-beta+1", True), (">1.0.0 nonsense", None), (">=17.5.0 <=17.5.0", True), (">17.5.0 <=17.5.0", False), (">=10.0.0", True), (None, None), ("^x", None),
]


def test_constraints(spark):
    df = spark.createDataFrame(CASES, "c string, want boolean")
    got = df.select("c", "want", ecosystem.allows_major(F.col("c"), [14, 15, 16, 17]).alias("got")).collect()
    assert [(r.c, r.got) for r in got] == [(r.c, r.want) for r in got]


def test_statuses_and_findings(spark):
    pytest.importorskip("yaml")
    view = "import 'package:provider/provider.dart';\nimport 'package:flutter_riverpod/flutter_riverpod.dart' as r;\nclass V extends r.ConsumerWidget {\n  f(c) { c.watch(1); watch(2); return ChangeNotifierProvider(); }\n}\n"
    spec = "name: x\ndependencies:\n  provider: ^6.0.0\n  go_router: ^9.0.0\n  flutter_riverpod:\n    git: https://example.org/r.git\ndependency_overrides:\n  flutter_riverpod: 3.0.0\n"
    rows = [("a", "pubspec", "pubspec.yaml", spec), ("a", "dart", "lib/v.dart", view), ("a", "dart", "lib/w.dart", "f(c) { c.watch(1); }"), ("b", "pubspec", "pubspec.yaml", "name: b\ndev_dependencies:\n  provider: any\n"), ("b", "dart", "lib/v.dart", view)]
    inputs = spark.createDataFrame(rows, "project_id string, kind string, path string, source string")
    facts, specs = code.extracted(inputs), assets.pubspecs(inputs)
    states = ecosystem.statuses(facts, specs, [t[0] for t in ecosystem.TABLE])
    assert {(r.project_id, r.convention): r.status for r in states.collect()} == {
        ("a", "provider"): "active", ("a", "go_router"): "unsupported_version", ("a", "flutter_riverpod"): "active", ("a", "flutter_bloc"): "dependency_missing",
        ("b", "provider"): "unverifiable_version", ("b", "go_router"): "dependency_missing", ("b", "flutter_riverpod"): "dependency_missing", ("b", "flutter_bloc"): "dependency_missing",
    }
    got = {(r.project_id, r.convention, r.path, r.pattern, r.kind) for r in ecosystem.findings(facts, conventions.code_facts(inputs), states).collect()}
    assert got == {("a", "provider", "lib/v.dart", "BuildContext.watch", "invocation"), ("a", "provider", "lib/v.dart", "ChangeNotifierProvider", "invocation"), ("a", "flutter_riverpod", "lib/v.dart", "ConsumerWidget", "base_class")}
    assert ecosystem.statuses(facts, specs, []).isEmpty() and ecosystem.support_table(spark).count() == 4
