"""How the queries over the generated tree run: files are dealt out to the cores, and each is parsed once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from .conftest import SMALL

from braidwork.functions import calls_text, source_text
from braidwork.plans import code, conventions, widget_tree
from tests.test_calls import SOURCE


def parses(df) -> int:
    """How many nodes of the plan send rows to Python in Arrow batches."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


@pytest.mark.parametrize("name", ["code_members", "code_bindings", "code_constructors", "code_themes", "code_invocations", "code_asset_uses"])
def test_one_pass_on_all_cores(spark, name):
    df = widget_tree.QUERIES[name](spark, SMALL)
    assert parses(df) == 1
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_names_resolve_by_file_then_library_then_imports(spark):
    """Columns beside the question are kept; a name that many files declare is looked up in its own file and library alone."""
    i = inputs(
        spark, ("lib/a.dart", "library l;\nimport 'c.dart';\npart 'b.dart';\nclass W {}\nclass A {}\n"), ("lib/b.dart", "part of l;\nclass B {}\nclass A {}\n"),
        ("lib/c.dart", "class C {}\nclass W {}\n"), ("lib/d.dart", "class D {}\nclass W {}\n"),
    )
    asked = [("lib/a.dart", "W"), ("lib/b.dart", "W"), ("lib/a.dart", "B"), ("lib/b.dart", "A"), ("lib/a.dart", "C"), ("lib/b.dart", "C"), ("lib/a.dart", "D"), ("lib/a.dart", "X"), ("lib/x.dart", "W"), ("lib/d.dart", "W")]
    q = spark.createDataFrame([("p", path, name, None, k) for k, (path, name) in enumerate(asked)], "project_id string, source_path string, name string, prefix string, place int")
    f = code.extracted(i)
    got = {r.place: (r.status, r.basis, r.symbol_id) for r in code.resolve(f, code.uri_edges(f, i), q).collect()}
    assert got == {
        0: ("resolved", "same_file", "lib/a.dart::class:W"), 1: ("resolved", "same_library", "lib/a.dart::class:W"), 2: ("resolved", "same_library", "lib/b.dart::class:B"), 3: ("resolved", "same_file", "lib/b.dart::class:A"),
        4: ("resolved", "direct_import", "lib/c.dart::class:C"), 5: ("resolved", "direct_import", "lib/c.dart::class:C"), 6: ("not_visible", None, None), 7: ("missing", None, None), 8: ("source_file_missing", None, None), 9: ("resolved", "same_file", "lib/d.dart::class:W"),
    }


@pytest.mark.parametrize(("name", "n"), [("code_definitions", 0), ("code_references", 0), ("code_routes", 1), ("code_inventory", 0), ("code_localizations", 1)])
def test_one_pass_before_a_shuffle(spark, name, n):
    """n is 0 where the facts are a table before they are used."""
    df = widget_tree.QUERIES[name](spark, SMALL)
    assert parses(df) == n
    assert n == 0 or "RepartitionByExpression [p_partkey" in df._jdf.queryExecution().optimizedPlan().toString()


def inputs(spark, *files):
    return spark.createDataFrame([("p", "dart", path, text) for path, text in files], "project_id string, kind string, path string, source string")


def test_a_read_is_bound_in_its_own_text(spark):
    """Two texts under one path do not lend each other their bindings."""
    facts = conventions.code_facts(inputs(spark, ("a.dart", "f(int x) { print(x); }"), ("a.dart", "g(int x) { print(x); }")))
    assert {(r.status, r.symbol_id) for r in conventions.bound_references(facts).collect()} == {("resolved", "a.dart::function:f/parameter:x"), ("resolved", "a.dart::function:g/parameter:x")}


def test_a_class_has_the_constructors_of_its_own_text(spark):
    facts = conventions.code_facts(inputs(spark, ("a.dart", "class A { A.one(); }"), ("a.dart", "class A { }")))
    assert sorted((r.constructor, r.implicit) for r in conventions.constructors(facts).collect()) == [("A", True), ("A.one", False)]


def test_routes_and_themes_are_the_same_with_facts_beside(spark):
    text = "import 'package:flutter/material.dart';\nconst k = '/k';\nf(c) { Navigator.pushNamed(c, k); Theme(data: d); MaterialApp.router(theme: t); GoRoute(path: '/$k'); }"
    i = inputs(spark, ("a.dart", text), ("b.dart", text.split("\n", 1)[1]))
    code_, facts = conventions.code_facts(i), code.extracted(i)
    both = conventions.code_facts(i, only=["invocations", "directives", "constants", "declarations"])
    for f in (conventions.routes, conventions.themes, conventions.inventory):
        rows = sorted(map(tuple, f(both).collect()), key=str)
        assert rows and rows == sorted(map(tuple, f(code_, facts).collect()), key=str)


def test_what_is_wanted_is_what_all_facts_hold():
    whole = calls_text.facts("a.dart", SOURCE) | source_text.facts("a.dart", SOURCE)
    for field in calls_text.FIELDS:
        assert calls_text.wanted("a.dart", SOURCE, [field])[field] == whole[field]
    assert calls_text.wanted("a.dart", SOURCE, list(whole)) == whole
    calls = calls_text.wanted("a.dart", SOURCE, ["invocations", "invocations.target", "invocations.span"], lines=False)["invocations"]
    assert [(c["target"], c["span"]) for c in calls] == [(c["target"], {k: c["span"][k] for k in ("byte_start", "byte_end")}) for c in whole["invocations"]]


def test_only_prunes_the_columns(spark):
    facts = conventions.code_facts(widget_tree.tree(spark, SMALL), only=["bindings.name", "bindings.declaration_span", "constants.name"], lines=False)
    assert facts.schema.simpleString() == "struct<project_id:string,path:string,bindings:array<struct<name:string,declaration_span:struct<byte_start:bigint,byte_end:bigint>>>,constants:array<struct<name:string>>>"
    row = facts.where("path = 'lib/p7.dart'").first()
    assert row.constants[0].name == "kRoot7" and "context" in {b.name for b in row.bindings}


def test_names_are_the_namespace_references_once_each():
    whole = calls_text.facts("a.dart", SOURCE)
    kinds = {"invocation_target", "constructor_target", "type_annotation"}
    want: dict = {}
    for r in whole["references"]:
        if r["kind"] in kinds:
            want.setdefault((r["name"], r["prefix"]), []).append((r["span"]["byte_start"], r["kind"]))
    got = calls_text.wanted("a.dart", SOURCE, ["names"])["names"]
    assert {(n["name"], n["prefix"]): [(p["byte_start"], p["kind"]) for p in n["places"]] for n in got} == {k: sorted(v) for k, v in want.items()}
    assert all(n["n"] == len(n["places"]) for n in got)
    assert {n["name"]: n["own"] for n in got if n["own"]} == {"Page": ["a.dart::class:Page"]}
    assert all("places" not in n for n in calls_text.wanted("a.dart", SOURCE, ["names", "names.n"])["names"])


def test_reference_counts_come_from_files_libraries_and_imports(spark):
    """What resolved_names leaves out counts for nothing: the counts are those over all definitions, and own names are joined to no file."""
    i = inputs(
        spark, ("lib/a.dart", "library l;\nimport 'e.dart';\nimport 'c.dart' as q;\npart 'b.dart';\nclass W {}\nvoid f() { W(); B(); C(); D(); X(); q.C(); }\n"),
        ("lib/b.dart", "part of l;\nclass B {}\nvoid g() { W(); W(); B(); C(); }\n"), ("lib/c.dart", "class C {}\nclass W {}\n"),
        ("lib/d.dart", "class D extends W {}\nclass W {}\nvoid h() { W(); C(); T(); }\nclass T {}\nclass T {}\n"), ("lib/e.dart", "export 'c.dart' show C;\n"),
    )
    fields = ["names", "library", "part_of_uri", "part_of_name", "directives", "parts", "declarations"]
    f = code.written(conventions.code_facts(i, only=fields), "facts")
    state = f, f, code.written(code.uri_edges(f, i), "uri-edges")
    rows = lambda df: {r.symbol_id: (r.n_references, r.n_files) for r in conventions.references_to(df).collect()}
    got = rows(conventions.resolved_names(*state))
    assert got == rows(conventions.definitions(*state))
    assert got == {"lib/a.dart::class:W": (3, 2), "lib/b.dart::class:B": (2, 2), "lib/c.dart::class:C": (3, 2), "lib/d.dart::class:W": (2, 1)}
    statuses = {(r.path, r.name): (r.status, r.basis) for r in conventions.definitions(*state).collect() if r.prefix is None}
    assert statuses["lib/a.dart", "C"] == ("resolved", "re_export") and statuses["lib/a.dart", "D"][0] == "not_visible" and statuses["lib/a.dart", "X"][0] == "missing" and statuses["lib/d.dart", "T"][0] == "ambiguous"


def test_lines_that_tell_nothing_are_passed_over():
    """Marks, parts and constants are found as before among lines without any, and constants only where they are wanted."""
    text = "library a.b;\nint x = 1;\n  import 'p.dart'\n    show Q;\npart 'c.dart';\nfinal k = 'v';\nf() {}\n<<<<<<< ours\n// import 'no.dart';\nexport 'z.dart'"
    got = source_text.facts("a.dart", text)
    assert (got["library"], [d["uri"] for d in got["directives"]], [p["uri"] for p in got["parts"]], [c["name"] for c in got["constants"]]) == ("a.b", ["p.dart", "z.dart"], ["c.dart"], ["k"])
    assert [d["code"] for d in got["diagnostics"]] == ["merge_conflict_marker", "directive_missing_semicolon"]
    assert calls_text.wanted("a.dart", text, ["directives"]) | {"constants": got["constants"]} == got
