from __future__ import annotations

from braidwork.functions import graphql_text
from braidwork.plans import code, contracts

OPS = """const kUser = r'''
query User($id: ID!, $n: Int) {
  # comment field
  user(id: $id) { name }
  other
}
''';
final kSave = \"\"\"mutation { save(x: 1) { ok } }\"\"\";
const kPlain = 'text';
"""
USE = """import 'ops.dart';
import 'hidden.dart' as h;
void main() {
  // é
  client.query(QueryOptions(document: gql(kUser), variables: {'id': 1, 'extra': {'deep': 2}}));
  client.query(options(gql(kSave)));
  gql(kPlain);
  gql(kNowhere);
  gql(h.kUser);
}
"""


def test_operations():
    got = graphql_text.operations(OPS)
    assert [(o["constant_name"], o["operation_type"], o["operation_name"], o["variable_names"], o["root_fields"]) for o in got] == [
        ("kUser", "query", "User", ["id", "n"], ["other", "user"]),
        ("kSave", "mutation", None, [], ["save"]),
    ]
    assert graphql_text.root_fields("no selection") == []


def test_uses():
    got = graphql_text.uses(USE)
    assert [(u["prefix"], u["constant_name"], u["client_call"], u["variable_names"]) for u in got] == [
        (None, "kUser", "query", ["extra", "id"]), (None, "kSave", "query", []), (None, "kPlain", None, []), (None, "kNowhere", None, []), ("h", "kUser", None, []),
    ]
    raw = USE.encode()
    assert raw[got[0]["span"]["byte_start"] : got[0]["span"]["byte_end"]] == b"gql(kUser)"


def test_bindings(spark):
    files = {"lib/ops.dart": OPS, "lib/use.dart": USE, "lib/hidden.dart": "const kOther = 1;\n"}
    i = spark.createDataFrame([("p", "dart", p, s) for p, s in files.items()], "project_id string, kind string, path string, source string")
    facts = code.extracted(i)
    got = {(r.constant_name, r.span.byte_start): r for r in contracts.bindings(facts, code.uri_edges(facts, i), contracts.extracted(i)).collect()}
    by = [got[k] for k in sorted(got, key=lambda k: k[1])]
    assert [(r.constant_name, r.status, r.call) for r in by] == [
        ("kUser", "bound", "compatible"), ("kSave", "bound", "incompatible"), ("kPlain", "missing_operation", "unknown"), ("kNowhere", "missing", "unknown"), ("kUser", "not_visible", "unknown"),
    ]
    assert (by[0].missing_variables, by[0].unexpected_variables) == (["n"], ["extra"])
