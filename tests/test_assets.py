from __future__ import annotations

from braidwork.functions import pubspec_text
from braidwork.plans import assets, code

SPEC = """name: demo
environment:
  sdk: '>=3.0.0 <4.0.0'
dependencies:
  flutter:
    sdk: flutter
  http: ^1.2.0
  local: {path: ../local}
  repo:
    git:
      url: https://example.com/r.git
      ref: main
dev_dependencies:
  test:
flutter:
  assets:
    - images/logo.png
    - data/
    - path: extra/only.txt
      flavors: [dev]
  fonts:
    - family: Sans
      fonts:
        - asset: fonts/s.ttf
          weight: 700
        - asset: fonts/t.ttf
          weight: 750
"""
APP = """class Home extends StatelessWidget {}
class Own extends w.State<Home> {}
class Plain extends Base {}
final a = Image.asset('images/logo.png');
final b = AssetImage("./data/x.json", package: 'p');
final c = rootBundle.loadString('data/deep/y.json'); // Image.asset('images/no.png')
final d = Image.asset('images/$name.png');
"""


def test_pubspec():
    got = pubspec_text.facts("pubspec.yaml", SPEC)
    assert got["package_name"] == "demo" and got["environment"] == {"sdk": ">=3.0.0 <4.0.0"}
    assert [(d["section"], d["name"], d["kind"], d["fields"]) for d in got["dependencies"]] == [
        ("dependencies", "flutter", "sdk", {"sdk": "flutter"}), ("dependencies", "http", "version", {"constraint": "^1.2.0"}), ("dependencies", "local", "path", {"path": "../local"}),
        ("dependencies", "repo", "git", {"git.url": "https://example.com/r.git", "git.ref": "main"}), ("dev_dependencies", "test", "version", {}),
    ]
    assert [a["asset"] for a in got["assets"]] == ["images/logo.png", "data/", "extra/only.txt"] and got["assets"][2]["flavors"] == ["dev"]
    assert [(f["asset"], f["weight"]) for f in got["fonts"]] == [("fonts/s.ttf", 700), ("fonts/t.ttf", None)]
    assert [d["code"] for d in got["diagnostics"]] == ["pubspec_invalid_flutter_font_weight"]


def test_broken_pubspecs():
    codes = lambda s: [d["code"] for d in pubspec_text.facts("p", s)["diagnostics"]]
    assert codes("") == ["pubspec_missing_name"] and codes("a: [") == ["pubspec_invalid_yaml"] and codes("name: Bad-Name") == ["pubspec_invalid_name"]
    assert codes("name: a\nname: b") == ["pubspec_duplicate_key"] and codes("name: a\n---\nname: b") == ["pubspec_multiple_documents_unsupported"]
    assert codes("name: a\nenvironment: 3") == ["pubspec_invalid_environment"]


def test_assets_and_widgets(spark):
    files = [("p", "pubspec", "pubspec.yaml", SPEC), ("p", "pubspec", "pkg/pubspec.yaml", "name: pkg\n"), ("p", "dart", "lib/app.dart", APP), ("p", "dart", "pkg/lib/x.dart", "final z = Image.asset('images/logo.png');\n")]
    i = spark.createDataFrame(files, "project_id string, kind string, path string, source string")
    specs = assets.pubspecs(i)
    assert {(r.path, r.package_name) for r in specs.collect()} == {("pubspec.yaml", "demo"), ("pkg/pubspec.yaml", "pkg")}
    assert assets.dependencies(specs).count() == 5
    assert {r.name for r in assets.widgets(code.extracted(i)).collect()} == {"Home", "Own"}
    declared, uses = assets.linked_assets(specs, assets.asset_uses(i))
    assert {(r.declared, r.use_count) for r in declared.collect()} == {("images/logo.png", 1), ("data/", 1), ("extra/only.txt", 0)}
    assert {(r.path, r.asset, r.declared) for r in uses.collect()} == {
        ("lib/app.dart", "images/logo.png", "images/logo.png"), ("lib/app.dart", "./data/x.json", "data/"), ("lib/app.dart", "data/deep/y.json", None), ("pkg/lib/x.dart", "images/logo.png", None),
    }
