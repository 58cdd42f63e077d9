"""Members, calls and references of texts; package configurations; the command line."""

from __future__ import annotations

import json

import pytest

from braidwork import cli
from braidwork.functions import calls_text, config_text
from braidwork.operators import graphs

SOURCE = """import 'package:flutter/material.dart';
class Page extends StatelessWidget with Mix, p.Other {
  final int size = 3, width = 4;
  @override
  final Map<String, int> all = {'a': 1};
  Page(this.size, {required String label, int n = 2});
  factory Page.of(Object o) => Page(1, label: 'x');
  set area(int v) { size = v; }
  bool operator ==(Object o) => true;
  T pick<T>(List<T> from) {
    var y = 1;
    y += 2;
    for (final q in from) { use(y, q); }
    return from.first;
  }
}
enum E { a, b; void go() {} }
void main() { runApp(const Page()); new Page.of(3); }
"""


def test_members_and_ids():
    got = {(m["kind"], m["name"]): m for m in calls_text.facts("a.dart", SOURCE)["members"]}
    want = [("class", "Page"), ("field", "size"), ("field", "width"), ("field", "all"), ("constructor", "Page"), ("constructor", "Page.of"), ("setter", "area"), ("operator", "=="), ("method", "pick"), ("local_variable", "y"), ("enum", "E"), ("method", "go"), ("function", "main")]
    assert set(want) <= set(got)
    assert got["method", "pick"]["parent_symbol_id"] == "a.dart::class:Page"
    assert got["local_variable", "y"]["symbol_id"] == "a.dart::class:Page/method:pick/local_variable:y"
    span = got["field", "width"]["declaration_span"]
    assert SOURCE[span["byte_start"] : span["byte_end"]] == "final int size = 3, width = 4;"


def test_calls_and_arguments():
    got = calls_text.facts("a.dart", "f() => g.h<int>(1, name: r'x\\n', m: {'k': v(2), // note\n 'l': 3})!.a.b(0)?.c;\nvoid k() { if (x) { y(); } }")["invocations"]
    first = next(c for c in got if c["target"] == "g.h")
    assert [(a["name"], a["expression"], a["string_value"]) for a in first["arguments"]][:2] == [(None, "1", None), ("name", "r'x\\n'", "x\\n")]
    assert [(e["string_key"], e["value"]) for e in first["arguments"][2]["map_entries"]] == [("k", "v(2)"), ("l", "3")]
    assert first["result_members"] == ["a"]
    last = next(c for c in got if c["target"] == "g.h.a.b")
    assert last["result_members"] == ["c"] and last["enclosing_symbol_id"] == "a.dart::function:f"
    assert {c["target"] for c in got} == {"g.h", "v", "g.h.a.b", "y"}


def test_references():
    got = {(r["kind"], r["prefix"], r["name"]) for r in calls_text.facts("a.dart", SOURCE)["references"]}
    assert {("type_annotation", None, "StatelessWidget"), ("type_annotation", "p", "Other"), ("constructor_target", None, "Page"), ("variable_read", None, "y"), ("variable_write", None, "y"), ("invocation_target", None, "runApp")} <= got


@pytest.mark.parametrize("text", ["", "class", "class A {", "f(", "}}}", "class A { A.( }", "a.b.c(<", "'", "é.x()", "class A { int operator", "enum E {", "f(a: ", "x({'k': }", "late late"])
def test_broken_texts_do_not_crash(text):
    calls_text.facts("a.dart", text)


def config(*packages, version=2, **more):
    return json.dumps({"configVersion": version, "packages": list(packages), **more})


def test_package_configs():
    codes = lambda text: [d["code"].removeprefix("package_config_") for d in config_text.package_config(".dart_tool/package_config.json", text)["diagnostics"]]
    assert codes("{") == codes('{"configVersion": true, "packages": []}') == ["invalid_json"]
    assert codes(config(version=3)) == ["unsupported_version"]
    assert codes(config(generated="2023-02-29T00:00:00.000Z", generator=3, generatorVersion="1.0")) == ["invalid_generated", "invalid_generator", "invalid_generator_version"]
    assert codes(config(generated="2024-02-29T23:59:59.999Z", generator="g", generatorVersion="1.0.0-a.1+7")) == []
    own = {"name": "a", "rootUri": "../", "packageUri": "lib/", "languageVersion": "3.1"}
    assert codes(config(own)) == []
    assert codes(config(own, own | {"rootUri": "../x"})) == ["duplicate_name"]
    assert codes(config(own | {"languageVersion": "3"}, {"name": "..", "rootUri": "../q?"})) == ["invalid_language_version", "invalid_name", "invalid_root_uri"]
    assert codes(config(own | {"packageUri": "../lib"})) == ["invalid_package_uri"]
    assert codes(config(own, own | {"name": "b"})) == ["duplicate_root"]
    assert codes(config(own, own | {"name": "b", "rootUri": "../lib/b"})) == ["package_uri_root_overlap"]
    assert codes(config(own, own | {"name": "b", "rootUri": "../pkgs/b"})) == []
    good = config_text.package_config("x y/.dart_tool/package_config.json", config(own, {"name": "far", "rootUri": "file:///opt/far"}))
    assert config_text.resolve_package_uri(good, "package:a/s%20t.dart") == ("resolved", "file:///__project__/x%20y/lib/s%20t.dart", "x y/lib/s t.dart")
    assert config_text.resolve_package_uri(good, "package:far/m.dart") == ("resolved", "file:///opt/far/m.dart", None)
    assert [config_text.resolve_package_uri(good, u)[0] for u in ("package:a/../m.dart", "package:a", "package:b/m.dart", "dart:io")] == ["invalid_package_uri", "invalid_package_uri", "unknown_package", "invalid_package_uri"]


def test_catalogs_and_lint_configuration():
    assert config_text.l10n("arb-dir: l\n")[0]["arb-dir"] == "l" and config_text.l10n("arb-dir: [1]")[1] == ["flutter_l10n_invalid_yaml"]
    locale, keys, codes = config_text.arb('{"@@locale": "de", "a": "x", "@a": {}, "b": "y"}')
    assert locale == "de" and [k for k, *_ in keys] == ["a", "b"] and codes == [] and config_text.arb("[]")[2] == ["flutter_arb_invalid_json"]
    assert config_text.lint_config('version = 1\nenabled_rules = ["orphan_file"]\n[orphan_files]\nentry_points = ["m.dart"]')["enabled_rules"] == ["orphan_file"]
    for bad in ("version = 2", "version = 1\nmore = 1", 'version = 1\nenabled_rules = ["x"]', 'version = 1\nenabled_rules = ["orphan_file", "orphan_file"]', 'version = 1\n[[forbidden_imports]]\npattern = ""', 'version = 1\nfailure_threshold = "x"', "version ="):
        with pytest.raises(ValueError):
            config_text.lint_config(bad)


def test_a_deep_chain_is_walked(spark):
    n = 600
    edges = spark.createDataFrame([(1, f"f{k}", f"f{k + 1}") for k in range(n)] + [(1, f"f{n}", "f0"), (2, "f0", "x")], "p long, src string, dst string")
    got = graphs.reachable(edges, spark.createDataFrame([(1, "f0")], "p long, node string"), ["p"]).collect()
    assert len(got) == n + 1 and max(r.depth for r in got) == n


def test_both_walks_are_the_same(spark, monkeypatch):
    edges = spark.createDataFrame([(k, (k * 7 + 3) % 40) for k in range(40)] + [(k, (k * 5) % 40) for k in range(40)], "src long, dst long")
    roots = spark.createDataFrame([("a", 1), ("b", 9)], "q string, node long")
    one = sorted(map(tuple, graphs.reachable(edges, roots, ["q"]).collect()))
    monkeypatch.setattr(graphs, "SMALL", 0)
    assert sorted(map(tuple, graphs.reachable(edges, roots, ["q"]).collect())) == one


@pytest.fixture
def project(tmp_path):
    for name, text in {
        "pubspec.yaml": "name: app\n", "lib/main.dart": "import 'a.dart';\nimport 'dart:io';\nvoid main() { A(); }\n", "lib/a.dart": "import 'package:app/main.dart';\nclass A {}\n", "lib/orphan.dart": "class bad_name {}\n",
        "lint.toml": 'version = 1\nenabled_rules = ["orphan_file", "naming_convention", "forbidden_import"]\nfailure_threshold = "warning"\n[severity_overrides]\norphan_file = "info"\n[orphan_files]\nentry_points = ["lib/main.dart"]\n[[forbidden_imports]]\npattern = "dart:"\nkind = "prefix"\n',
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_commands(spark, project, capsys):
    run = lambda *args: (cli.main(list(args)), capsys.readouterr().out)
    status, out = run("analyze-file", str(project / "lib/main.dart"))
    assert status == cli.OK and json.loads(out)["schema"] == "braidwork.file-analysis" and [c["target"] for c in json.loads(out)["data"]["invocations"]] == ["A"]
    assert json.loads(run("pubspec", str(project / "pubspec.yaml"))[1])["data"]["package_name"] == "app"
    assert json.loads(run("pubspec-config", str(project / "pubspec.yaml"))[1])["version"] == 1
    edges = json.loads(run("uri-graph", str(project))[1])["data"]
    assert [(e["source_path"], e["uri"], e["resolution"]) for e in edges] == [("lib/a.dart", "package:app/main.dart", "resolved"), ("lib/main.dart", "a.dart", "resolved"), ("lib/main.dart", "dart:io", "external")]
    assert json.loads(run("analyze-project", str(project))[1])["data"]["summary"][0]["n_files"] == 3
    assert json.loads(run("flutter-inventory", str(project))[1])["data"]["summary"][0]["flutter_routes"] == 0
    assert json.loads(run("graphql-contracts", str(project))[1])["data"] == []
    status, out = run("lint", str(project), "--config", str(project / "lint.toml"))
    assert status == cli.FINDINGS and sorted((d["rule_id"], d["severity"]) for d in json.loads(out)["data"]["diagnostics"]) == [("forbidden_import", "warning"), ("naming_convention", "warning"), ("orphan_file", "info")]
    status, out = run("lint", str(project), "--config", str(project / "lint.toml"), "--format", "sarif")
    assert status == cli.FINDINGS and len(json.loads(out)["runs"][0]["results"]) == 3


def test_exit_statuses(tmp_path):
    assert cli.main(["nothing", "x"]) == cli.USAGE and cli.main(["uri-graph", "x", "--env", "k"]) == cli.USAGE
    assert cli.main(["pubspec", str(tmp_path / "none")]) == cli.INPUT
    (tmp_path / "c.toml").write_text("version = 9")
    assert cli.main(["lint", str(tmp_path), "--config", str(tmp_path / "c.toml")]) == cli.CONFIGURATION
    assert [cli.fails(["warning"], t) for t in ("never", "warning", "error")] == [False, True, False] and cli.fails(["warning"], "error", True)
