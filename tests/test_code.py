from __future__ import annotations

import json
import random

from braidwork.functions import paths, source_text
from braidwork.plans import code
from braidwork.sources import projects

FILES = {
    "pubspec.yaml": "name: demo\n",
    "lib/a.dart": "import 'b.dart';\nimport 'package:demo/c.dart';\nimport 'dart:async';\nexport 'missing.dart';\n",
    "lib/b.dart": "export 'c.dart' show C;\n",
    "lib/c.dart": "class C {}\nclass _P {}\n",
    "lib/lib.dart": "library demo.lib;\nimport 'b.dart' as b hide X;\npart 'part.dart';\npart 'gone.dart';\nclass Lone {}\n",
    "lib/part.dart": "part of 'lib.dart';\nclass InPart {}\n",
    "lib/cond.dart": "import 'x.dart'\n  if (dart.library.io) 'c.dart'\n  if (flag == 'on') 'b.dart';\n",
    "lib/BadName.dart": "class lower {}\nvoid Upper() {}\n",
}


def inputs(spark, files=None):
    kinds = lambda p: "pubspec" if p.endswith("pubspec.yaml") else "package_config" if p.endswith(".json") else "dart"
    return spark.createDataFrame([("p", kinds(p), p, s) for p, s in (files or FILES).items()], "project_id string, kind string, path string, source string")


def test_mask_keeps_length_and_lines():
    rng = random.Random(8)
    bits = ["'", '"', "'''", '"""', "r'", "//", "/*", "*/", "\\", "\n", "\r\n", "é", "x", " ", ";", "日"]
    for _ in range(500):
        raw = "".join(rng.choice(bits) for _ in range(rng.randrange(40))).encode()
        masked, _ = source_text.mask(raw)
        assert len(masked) == len(raw)
        assert [c for c in masked if c in b"\r\n"] == [c for c in raw if c in b"\r\n"]
        assert all(a == b or a == 32 for a, b in zip(masked, raw, strict=True))


def test_mask_cases():
    assert source_text.mask(b"a /* x /* y */ z */ b // c\nd")[0].split() == [b"a", b"b", b"d"]
    assert source_text.mask(b"r'\\' e")[0] == b"     e"
    assert [c for c, *_ in source_text.mask(b"'open\nnext /* deep /* */")[1]] == ["unterminated_string", "unterminated_block_comment"]


def test_paths(spark):
    cases = [("lib/src", "../b.dart", "lib/b.dart"), ("", "../../x", "x"), ("a/b", "./c/./d", "a/b/c/d"), ("a", "/r/x", "/r/x")]
    for base, rel, want in cases:
        assert paths.joined(base, rel) == want
    df = spark.createDataFrame(cases, "a string, b string, want string")
    from pyspark.sql import functions as F

    assert df.where(paths.joined_column(F.col("a"), F.col("b")) != F.col("want")).isEmpty()


def test_uri_edges(spark):
    i = inputs(spark)
    f = code.extracted(i)
    got = {(r.source_path, r.uri, r.kind, r.span.byte_start, r.span.byte_end): (r.resolution, r.target_path) for r in code.uri_edges(f, i).collect()}
    assert got["lib/a.dart", "b.dart", "import", 0, 16] == ("resolved", "lib/b.dart")
    assert got["lib/a.dart", "package:demo/c.dart", "import", 17, 46] == ("resolved", "lib/c.dart")
    assert got["lib/a.dart", "dart:async", "import", 47, 67] == ("external", None)
    assert got["lib/a.dart", "missing.dart", "export", 68, 90] == ("missing_target", "lib/missing.dart")
    assert got["lib/b.dart", "c.dart", "export", 0, 23] == ("resolved", "lib/c.dart")
    assert sum(k[0] == "lib/cond.dart" for k in got) == 3
    env = {r.uri for r in code.uri_edges(f, i, {"flag": "on"}).where("source_path = 'lib/cond.dart'").collect()}
    assert env == {"b.dart"}


def test_package_configs_and_ambiguity(spark):
    config = {"configVersion": 2, "packages": [{"name": "far", "rootUri": "../vendor/far", "packageUri": "lib/"}]}
    files = {
        ".dart_tool/package_config.json": json.dumps(config), "lib/m.dart": "import 'package:far/x.dart';\nimport 'package:none/x.dart';\nimport 'http://x';\n", "vendor/far/lib/x.dart": "class X {}\n",
    }
    i = inputs(spark, files)
    got = {r.uri: (r.resolution, r.target_path) for r in code.uri_edges(code.extracted(i), i).collect()}
    assert got == {"package:far/x.dart": ("resolved", "vendor/far/lib/x.dart"), "package:none/x.dart": ("unindexed_package", None), "http://x": ("unsupported_scheme", None)}
    two = {"a/pubspec.yaml": "name: t\n", "b/pubspec.yaml": "name: t\n", "m.dart": "import 'package:t/x.dart';\n"}
    i = inputs(spark, two)
    r = code.uri_edges(code.extracted(i), i).first()
    assert (r.resolution, r.candidate_paths) == ("ambiguous_package", ["a/lib/x.dart", "b/lib/x.dart"])


def test_symbols(spark):
    i = inputs(spark)
    f = code.extracted(i)
    asked = [("lib/a.dart", "C", None), ("lib/a.dart", "_P", None), ("lib/c.dart", "_P", None), ("lib/a.dart", "Nope", None), ("lib/zz.dart", "C", None), ("lib/lib.dart", "InPart", None), ("lib/part.dart", "C", "b"), ("lib/part.dart", "C", None)]
    q = spark.createDataFrame([("p", *x) for x in asked], "project_id string, source_path string, name string, prefix string")
    got = {(r.source_path, r.name, r.prefix): (r.status, r.basis) for r in code.resolve(f, code.uri_edges(f, i), q).collect()}
    want = [("resolved", "direct_import"), ("not_visible", None), ("resolved", "same_file"), ("missing", None), ("source_file_missing", None), ("resolved", "same_library"), ("resolved", "re_export"), ("not_visible", None)]
    assert got == dict(zip(asked, want, strict=True))


def test_parts_and_lints(spark):
    i = inputs(spark)
    f = code.extracted(i)
    e = code.uri_edges(f, i)
    assert {(r.part_uri, r.status) for r in code.part_links(f, e).collect()} == {("part.dart", "matched"), ("gone.dart", "missing_part")}
    config = {
        "enabled_rules": ["forbidden_import", "layer_boundary", "naming_convention", "unresolved_part", "orphan_file"], "severity_overrides": {"forbidden_import": "error"},
        "forbidden_imports": [{"pattern": "dart:", "kind": "prefix"}], "layer_boundaries": [{"source": "lib/a", "target": "lib/c"}], "orphan_files": {"entry_points": ["lib/a.dart", "lib/lib.dart"]},
    }
    found = code.lint(f, e, config)
    got = {(r.rule_id, r.path, r.severity) for r in found.collect()}
    assert got == {
        ("forbidden_import", "lib/a.dart", "error"), ("layer_boundary", "lib/a.dart", "warning"), ("naming_convention", "lib/BadName.dart", "warning"), ("unresolved_part", "lib/lib.dart", "warning"),
        ("orphan_file", "lib/cond.dart", "warning"), ("orphan_file", "lib/BadName.dart", "warning"),
    }
    rules = config["enabled_rules"]
    doc = json.loads(code.sarif([r.json for r in code.sarif_results(found, rules).orderBy("path", "byte_start").collect()], rules))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == found.count()
    assert code.lint(f, e, {}).count() == 0
    assert code.summary(f, e).first().n_files == 7
    assert json.loads(code.envelope(code.summary(f, e), "project-summary", ["project_id"]).first().json)["version"] == 1


def test_tree_scan_and_duplicates(spark, tmp_path):
    for p, s in {**FILES, "build/x.dart": "class Skipped {}", "node_modules/y/z.dart": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(s)
    tree = projects.within_budget(projects.read_tree(spark, str(tmp_path)))
    assert {r.path: r.source for r in tree.collect()} == FILES
    more = tree.select("project_id", "kind", "path", "source")
    again = more.union(more.where("path = 'lib/a.dart'")).union(spark.createDataFrame([("project", "dart", "lib\\b.dart", "other")], more.schema))
    good, said = projects.unique_inputs(again)
    assert {r.path for r in good.collect()} == set(FILES) - {"lib/b.dart"}
    assert {(r.path, r.severity) for r in said.collect()} == {("lib/a.dart", "warning"), ("lib/b.dart", "error")}


def test_symlinks(spark, tmp_path):
    import pytest

    root, far = tmp_path / "root", tmp_path / "far"
    for d in (root / "lib", root / "build", far):
        d.mkdir(parents=True)
    (root / "lib/a.dart").write_text("class A {}\n")
    (far / "x.dart").write_text("")
    (root / "lib/near.dart").symlink_to(root / "lib/a.dart")
    (root / "build/out.dart").symlink_to(far / "x.dart")
    projects.reject_symlinks(str(root))
    assert {r.path: r.source for r in projects.read_tree(spark, str(root)).collect()} == dict.fromkeys(("lib/a.dart", "lib/near.dart"), "class A {}\n")
    for name, to in (("out.dart", far / "x.dart"), ("dir", root / "build"), ("gone.dart", root / "none")):
        (root / name).symlink_to(to)
        with pytest.raises(ValueError, match="input_symlink_rejected"):
            projects.reject_symlinks(str(root))
        (root / name).unlink()
    projects.reject_symlinks("s3a://bucket/none")


def test_budget_reads_no_content(spark, tmp_path, monkeypatch):
    import pytest

    (tmp_path / "a.dart").write_text("class A {}\n")
    tree = projects.read_tree(spark, str(tmp_path))
    assert projects.within_budget(tree) is tree
    monkeypatch.setattr(projects, "FILE_BYTES", 3)
    with pytest.raises(ValueError, match="input_limit_exceeded"):
        projects.within_budget(tree)
