"""Queries over a generated source tree of widgets, a file for each part: members, calls, conventions, bindings and definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from . import assets, code, conventions, ecosystem, incremental
from .catalogue import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A part's file; @K is its key and @S its size. Comments and strings hold what must not be read as code.
FILE = """// class Fake { Image.asset('no.png')
import 'package:flutter/material.dart';
const kRoot@K = '/r@K';
/* ThemeData() { ' */
class P@K extends StatelessWidget {
  final int size = @S;
  static String label = "it's; {";
  P@K.named(int n);
  int get area => size;
  Widget build(BuildContext context) {
    final a = Image.asset('img/@K.png', package: 'pk@S');
    print(a);
    Navigator.pushNamed(context, '$kRoot@K/x');
    Navigator.of(context).pushNamed('/n@K');
    return MaterialApp(home: W(), routes: {'/t@K': (c) => W()}, theme: ThemeData(useMaterial3: true));
  }
  String t(c) => AppLocalizations.of(c)!.key@S;
}
class W {}
"""
#: The messages of the project's template.
KEYS = 25
_QUOTED = FILE.replace("'", "''")
#: DuckDB's view of the same files: path, k, s, source and the ids of the class and its build method.
_FILES = f"""files as (select 'lib/p' || p_partkey || '.dart' as path, p_partkey as k, p_size as s, 'lib/p' || p_partkey || '.dart::class:P' || p_partkey as c,
  replace(replace('{_QUOTED}', '@K', p_partkey::varchar), '@S', p_size::varchar) as src from part)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and sizes of the parts, dealt out to more tasks than cores: a table of a few MB is read in one, and its files take far longer to parse than to move as keys."""
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(tasks, "p_partkey")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, and one ARB catalog with KEYS messages."""
    text = F.replace(F.replace(F.lit(FILE), F.lit("@K"), F.col("p_partkey").cast("string")), F.lit("@S"), F.col("p_size").cast("string"))
    files = _parts(spark, sf_dir).select(F.lit("parts").alias("project_id"), F.lit("dart").alias("kind"), F.concat(F.lit("lib/p"), "p_partkey", F.lit(".dart")).alias("path"), text.alias("source"))
    catalog = '{"@@locale": "en", ' + ", ".join(f'"key{k}": "text {k}"' for k in range(1, KEYS + 1)) + "}"
    arb = spark.range(1).select(F.lit("parts").alias("project_id"), F.lit("arb").alias("kind"), F.lit("lib/l10n/app_en.arb").alias("path"), F.lit(catalog).alias("source"))
    return files.union(arb)


def _registered(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"with {_FILES} {sql}"
        return f

    return add


@_registered("""
select path, m.kind as kind, m.name as name, m.id as symbol_id, m.parent as parent_symbol_id from files, unnest([
  {kind: 'variable', name: 'kRoot' || k, id: path || '::variable:kRoot' || k, parent: null}, {kind: 'class', name: 'P' || k, id: c, parent: null},
  {kind: 'field', name: 'size', id: c || '/field:size', parent: c}, {kind: 'field', name: 'label', id: c || '/field:label', parent: c},
  {kind: 'constructor', name: 'P' || k || '.named', id: c || '/constructor:P' || k || '.named', parent: c}, {kind: 'getter', name: 'area', id: c || '/getter:area', parent: c},
  {kind: 'method', name: 'build', id: c || '/method:build', parent: c}, {kind: 'local_variable', name: 'a', id: c || '/method:build/local_variable:a', parent: c || '/method:build'},
  {kind: 'method', name: 't', id: c || '/method:t', parent: c}, {kind: 'class', name: 'W', id: path || '::class:W', parent: null}]) as u(m)
""")
def code_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declaration of every file, members and locals with their ids."""
    wanted = ["kind", "name", "symbol_id", "parent_symbol_id"]
    return conventions.members(conventions.code_facts(tree(spark, sf_dir), only=[f"members.{w}" for w in wanted], lines=False)).select("path", *wanted)


@_registered("""
select path, m.target as target, m.n as n_arguments, c || '/method:' || m.inside as enclosing_symbol_id, (strpos(src, m.find) - 1 + m.skip)::bigint as byte_start, m.members as result_members from files, unnest([
  {target: 'Image.asset', n: 2, inside: 'build', find: 'Image.asset(''img', skip: 0, members: ''}, {target: 'print', n: 1, inside: 'build', find: 'print(', skip: 0, members: ''},
  {target: 'Navigator.pushNamed', n: 2, inside: 'build', find: 'Navigator.push', skip: 0, members: ''}, {target: 'Navigator.of', n: 1, inside: 'build', find: 'Navigator.of', skip: 0, members: ''},
  {target: 'Navigator.of.pushNamed', n: 1, inside: 'build', find: 'Navigator.of', skip: 0, members: ''}, {target: 'MaterialApp', n: 3, inside: 'build', find: 'MaterialApp', skip: 0, members: ''},
  {target: 'W', n: 0, inside: 'build', find: 'home: W', skip: 6, members: ''}, {target: 'W', n: 0, inside: 'build', find: '=> W()', skip: 3, members: ''},
  {target: 'ThemeData', n: 1, inside: 'build', find: 'ThemeData(use', skip: 0, members: ''}, {target: 'AppLocalizations.of', n: 1, inside: 't', find: 'AppLocalizations', skip: 0, members: 'key' || s}]) as u(m)
""")
def code_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every dotted chain, with its arguments counted and the innermost callable around it."""
    calls = conventions.invocations(conventions.code_facts(tree(spark, sf_dir), only=["invocations.target", "invocations.arguments.byte_start", "invocations.result_members", "invocations.enclosing_symbol_id", "invocations.span"], lines=False))
    return calls.select("path", "target", F.size("arguments").alias("n_arguments"), "enclosing_symbol_id", F.col("span.byte_start").alias("byte_start"), F.array_join("result_members", ",").alias("result_members"))


@_registered("""
select path, 'image_asset' as source, 'img/' || k || '.png' as asset, 'pk' || s as package, (strpos(src, 'Image.asset(''img') - 1)::bigint as byte_start from files
""")
def code_asset_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that name an asset, with their package."""
    wanted = ["target", "arguments.name", "arguments.expression", "arguments.string_value", "span"]
    return conventions.asset_uses(conventions.code_facts(tree(spark, sf_dir), only=[f"invocations.{w}" for w in wanted], lines=False)).select("path", "source", "asset", "package", "byte_start")


@_registered("""
select path, m.constructor as constructor, m.route as route, m.kind as kind, m.resolved as resolved, m.confidence as confidence from files, unnest([
  {constructor: 'Navigator.pushNamed', route: '$kRoot' || k || '/x', kind: 'expression', resolved: '/r' || k || '/x', confidence: 'high'},
  {constructor: 'Navigator.of.pushNamed', route: '/n' || k, kind: 'literal', resolved: '/n' || k, confidence: 'high'},
  {constructor: 'MaterialApp.home', route: '/', kind: 'literal', resolved: '/', confidence: 'high'},
  {constructor: 'MaterialApp.routes', route: '/t' || k, kind: 'literal', resolved: '/t' || k, confidence: 'high'}]) as u(m)
""")
def code_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of applications and navigators, interpolated from constants of the same file."""
    facts = conventions.code_facts(tree(spark, sf_dir), only=["invocations.target", "invocations.arguments", "directives.kind", "directives.uri", "constants.name", "constants.value"], lines=False)
    return conventions.routes(facts).select("path", "constructor", "route", "kind", "resolved", "confidence")


@_registered(f"""
select path, 'key' || s as key, case when s > {KEYS} then 'flutter_localization_key_missing' end as code, (strpos(src, 'AppLocalizations') - 1)::bigint as byte_start from files
""")
def code_localizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are used, against the template catalog."""
    inputs = tree(spark, sf_dir)
    uses = conventions.code_facts(inputs, only=["invocations.target", "invocations.result_members", "invocations.span"], lines=False)
    return conventions.localization_keys(uses, inputs).select("path", "key", "code", "byte_start")


@_registered("""
select path, 'theme_data' as kind, null::varchar as expression, (strpos(src, 'ThemeData(use') - 1)::bigint as byte_start from files
union all select path, 'material_app_theme', 'ThemeData(useMaterial3: true)', strpos(src, 'theme: ThemeData') - 1 from files
""")
def code_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes made and the slots that take them."""
    wanted = ["target", "arguments.name", "arguments.expression", "arguments.byte_start", "span"]
    facts = conventions.code_facts(tree(spark, sf_dir), only=[*(f"invocations.{w}" for w in wanted), "directives.kind", "directives.uri"], lines=False)
    return conventions.themes(facts).select("path", "kind", "expression", "byte_start")


@_registered("""
select 'parts' as project_id, count(*) as flutter_widgets, 4 * count(*) as flutter_routes, count(*) as flutter_assets, count(*) as flutter_localizations from files
""")
def code_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widgets, routes, assets and localizations of the project, counted."""
    wanted = ["target", "arguments", "result_members", "span"]
    only = [*(f"invocations.{w}" for w in wanted), "directives.kind", "directives.uri", "constants.name", "constants.value", "declarations"]
    return conventions.inventory(code.written(conventions.code_facts(tree(spark, sf_dir), only=only, lines=False), "code-facts"))


@_registered("""
select path, m.name as name, 'variable_read' as kind, (strpos(src, m.find) - 1 + m.skip)::bigint as byte_start, 'resolved' as status, c || m.id as symbol_id from files, unnest([
  {name: 'a', find: 'print(a', skip: 6, id: '/method:build/local_variable:a'}, {name: 'context', find: 'pushNamed(context', skip: 10, id: '/method:build/parameter:context'},
  {name: 'context', find: 'of(context', skip: 3, id: '/method:build/parameter:context'}, {name: 'c', find: 'of(c)', skip: 3, id: '/method:t/parameter:c'}]) as u(m)
""")
def code_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of variables, with the innermost binding in whose scope they are."""
    wanted = [*(f"references.{w}" for w in ("name", "kind", "span")), *(f"bindings.{w}" for w in ("name", "symbol_id", "declaration_span", "scope_start", "scope_end"))]
    return conventions.bound_references(conventions.code_facts(tree(spark, sf_dir), only=wanted, lines=False)).select("path", "name", "kind", "byte_start", "status", "symbol_id")


@_registered("""
, r as (select path, m.name as name, m.prefix as prefix, m.kind as kind, case when m.name = 'W' then path || '::class:W' end as symbol_id from files, unnest([
  {name: 'StatelessWidget', prefix: null, kind: 'type_annotation'}, {name: 'asset', prefix: 'Image', kind: 'invocation_target'}, {name: 'print', prefix: null, kind: 'invocation_target'},
  {name: 'pushNamed', prefix: 'Navigator', kind: 'invocation_target'}, {name: 'of', prefix: 'Navigator', kind: 'invocation_target'}, {name: 'MaterialApp', prefix: null, kind: 'invocation_target'},
  {name: 'W', prefix: null, kind: 'invocation_target'}, {name: 'W', prefix: null, kind: 'invocation_target'}, {name: 'ThemeData', prefix: null, kind: 'invocation_target'},
  {name: 'of', prefix: 'AppLocalizations', kind: 'invocation_target'}]) as u(m))
select path, name, prefix, kind, case when symbol_id is null then 'missing' else 'resolved' end as status, case when symbol_id is not null then 'same_file' end as basis, symbol_id from r
""")
def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declaration that each name of a call, a constructor or a type clause means."""
    found = conventions.definitions(*_named(spark, sf_dir, "places"))
    return found.select("path", "name", "prefix", "kind", "status", "basis", "symbol_id")


def _named(spark: SparkSession, sf_dir: str, how: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts with the names that files ask for, twice, and the edges between files."""
    inputs = tree(spark, sf_dir)
    wanted = ["names.name", "names.prefix", "names.own", f"names.{how}", "library", "part_of_uri", "part_of_name", "directives", "parts", "declarations.name", "declarations.symbol_id"]
    facts = code.written(conventions.code_facts(inputs, only=wanted, lines=False), "facts")
    return facts, facts, code.written(code.uri_edges(facts, inputs), "uri-edges")


@_registered("""
select path || '::class:W' as symbol_id, 2::bigint as n_references, 1::bigint as n_files from files
""")
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each declaration is referred to."""
    return conventions.references_to(conventions.resolved_names(*_named(spark, sf_dir, "n"))).select("symbol_id", "n_references", "n_files")


@_registered("""
select path, 'P' || k as owner, 'P' || k || '.named' as constructor, c || '/constructor:P' || k || '.named' as symbol_id, false as implicit from files
union all select path, 'W', 'W', path || '::class:W', true from files
""")
def code_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constructors of each class, the implicit one of a class without any included."""
    wanted = ["name", "kind", "symbol_id", "parent_symbol_id"]
    return conventions.constructors(conventions.code_facts(tree(spark, sf_dir), only=[f"members.{w}" for w in wanted], lines=False)).select("path", "owner", "constructor", "symbol_id", "implicit")


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree after an edit, by the key's last digit: 0 is removed, 1 gets a class, 2 another import, 3 a comment, 4 a new file beside it."""
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("lib/p"), "p_partkey", F.lit(".dart")).alias("path"), F.col("p_partkey").alias("k"))
    digit = F.col("k") % 10
    kept = tree(spark, sf_dir).where("kind = 'dart'").join(files, "path").where(digit != 0)
    source = F.when(digit == 1, F.concat("source", F.lit("class Extra {}\n"))).when(digit == 2, F.replace("source", F.lit("material.dart"), F.lit("widgets.dart"))).when(digit == 3, F.concat("source", F.lit("// tail\n"))).otherwise(F.col("source"))
    added = files.where(digit == 4).select(F.lit("parts").alias("project_id"), F.lit("dart").alias("kind"), F.concat(F.lit("lib/q"), "k", F.lit(".dart")).alias("path"), F.concat(F.lit("class lower"), "k", F.lit(" {}\n")).alias("source"))
    return kept.select("project_id", "kind", "path", source.alias("source")).union(added)


def _state(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    facts = code.written(code.extracted(inputs), "facts")
    return facts, code.written(code.uri_edges(facts, inputs), "uri-edges")


@_registered("""
select case when k % 10 = 4 then 'lib/q' || k || '.dart' else path end as path, case k % 10 when 0 then 'removed' when 4 then 'added' else 'changed' end as change,
  case k % 10 when 1 then 'declarations' when 2 then 'directives,constants,declarations' else '' end as changed_fields,
  true as project, k % 10 <> 1 as uri_graph, k % 10 in (0, 4) as part_links, true as identifier_references, true as propagate_dependents
from files where k % 10 in (0, 1, 2, 4)
""")
def code_rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edit of the tree makes necessary, file by file."""
    plan = incremental.rebuild_plan(code.extracted(tree(spark, sf_dir)), code.extracted(_edited(spark, sf_dir)))
    return plan.select("path", "change", F.array_join("changed_fields", ",").alias("changed_fields"), *incremental.SUBSYSTEMS)


_RULES = {"enabled_rules": ["forbidden_import", "naming_convention"], "forbidden_imports": [{"pattern": "package:flutter/", "kind": "prefix"}]}


@_registered("""
select path, 'forbidden_import' as rule_id, 'import ''package:flutter/' || case when k % 10 = 2 then 'widgets' else 'material' end || '.dart'' is forbidden by ''package:flutter/''' as message,
  (instr(src, 'import') - 1)::bigint as byte_start from files where k % 10 <> 0
union all select 'lib/q' || k || '.dart', 'naming_convention', '''lower' || k || ''' is not UpperCamelCase', 0::bigint from files where k % 10 = 4
""")
def code_incremental_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings after the edit: those of untouched libraries are kept, the others computed."""
    old, new = _state(tree(spark, sf_dir).where("kind = 'dart'")), _state(_edited(spark, sf_dir))
    kept = code.written(code.lint(*old, _RULES), "findings")
    paths = incremental.affected_paths(incremental.rebuild_plan(old[0], new[0]), old, new)
    own = incremental.affected_libraries(paths, incremental.libraries(*old), incremental.libraries(*new))
    return incremental.lint_update(kept, own, old, new, _RULES).select("path", "rule_id", "message", F.col("span.byte_start").alias("byte_start"))


#: A project for each part: what it depends on, and a view that uses it.
SPEC = "name: e@K\ndependencies:\n  provider: @V\n"
VIEW = "import 'package:provider/provider.dart';\nimport 'package:flutter_bloc/flutter_bloc.dart';\nf(c) { c.watch(@K); watch(1); return MultiProvider(); }\n"
#: Constraints by the key's last digit; none for the others.
CONSTRAINTS = ["^6.0.0", "'>=5.0.0 <6.0.1'", "'>=7.0.0'", "any", "6.1.5+1", "<6.0.0", "'>5.0.0 || 6'"]


@_registered("""
, s as (select 'e' || k as project_id, case when k % 10 in (0, 1, 4) then 'active' when k % 10 in (2, 5) then 'unsupported_version' when k % 10 in (3, 6) then 'unverifiable_version' else 'dependency_missing' end as status from files)
select project_id, convention, case when convention = 'provider' then status else 'dependency_missing' end as status,
  case when convention = 'provider' and status = 'active' then 'BuildContext.watch,MultiProvider' else '' end as patterns
from s, (values ('provider'), ('flutter_bloc')) as c(convention)
""")
def code_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conventions hold in each project, and the patterns found."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("e"), "p_partkey").alias("project_id"), F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 10).cast("int").alias("digit"))
    constraint = F.get(F.array(*map(F.lit, CONSTRAINTS)), F.col("digit"))
    spec = F.when(constraint.isNull(), F.replace(F.lit("name: e@K\n"), F.lit("@K"), F.col("k"))).otherwise(F.replace(F.replace(F.lit(SPEC), F.lit("@K"), F.col("k")), F.lit("@V"), constraint))
    file = lambda kind, path, source: part.select("project_id", F.lit(kind).alias("kind"), F.lit(path).alias("path"), source.alias("source"))
    inputs = file("pubspec", "pubspec.yaml", spec).union(file("dart", "lib/view.dart", F.replace(F.lit(VIEW), F.lit("@K"), F.col("k"))))
    facts = code.written(code.extracted(inputs), "facts")
    states = code.written(ecosystem.statuses(facts, assets.pubspecs(inputs), ["provider", "flutter_bloc"]), "conventions")
    found = ecosystem.findings(facts, conventions.code_facts(inputs), states)
    each = found.groupBy("project_id", "convention").agg(F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"))  # at most the table's
    return states.join(each, ["project_id", "convention"], "left").select("project_id", "convention", "status", F.coalesce("patterns", F.lit("")).alias("patterns"))
