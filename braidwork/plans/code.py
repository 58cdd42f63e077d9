"""Questions over source trees: URI graph, parts, symbols, lints.

Inputs are tables (project_id, kind, path, source). Each file is parsed once, in Python; all that crosses
files is joins and closures over the facts.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config_text, paths, source_text
from ..operators import graphs
from ..tables import written

_SPAN = "struct<byte_start: long, byte_end: long, start_line: long, start_column: long, end_line: long, end_column: long>"
_FACTS = (
    "project_id string, path string, library string, part_of_uri string, part_of_name string, "
    f"directives array<struct<kind: string, uri: string, configurations: array<struct<condition: string, uri: string>>, is_deferred: boolean, prefix: string, combinators: array<struct<kind: string, names: array<string>>>, span: {_SPAN}>>, "
    f"parts array<struct<uri: string, span: {_SPAN}>>, constants array<struct<name: string, value: string, span: {_SPAN}>>, "
    f"declarations array<struct<name: string, kind: string, symbol_id: string, extends: string, span: {_SPAN}>>, diagnostics array<struct<code: string, severity: string, span: {_SPAN}>>"
)


def extracted(inputs: DataFrame, parser=source_text.facts) -> DataFrame:
    """The facts of each Dart file. parser: (path, source) -> facts; another one can be put in its place."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_FACTS))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                rows = [{"project_id": r["project_id"], **parser(r["path"], r["source"] or "")} for r in batch.slice(lo, 200).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = inputs.where("kind = 'dart'").select(F.col("project_id").cast("string").alias("project_id"), "path", "source")
    return files.mapInArrow(run, _FACTS)


def package_roots(inputs: DataFrame) -> DataFrame:
    """(project_id, package, root) of the pubspecs: the top-level name and the file's directory."""
    name = F.regexp_extract("source", r"(?m)^name:[ \t]*[\"']?([A-Za-z_][A-Za-z0-9_]*)[\"']?[ \t]*(?:#.*)?$", 1)
    return inputs.where("kind = 'pubspec'").select("project_id", name.alias("package"), paths.parent_column("path").alias("root")).where("package <> ''").distinct()


_CONFIG = "project_id string, path string, config_version long, packages array<struct<name: string, root_uri: string, package_uri: string, language_version: string, lib: string>>, generated string, generator string, generator_version string, diagnostics array<struct<code: string, severity: string>>"


def config_analyses(inputs: DataFrame) -> DataFrame:
    """A row for each package configuration: its entries, each with its library directory if that is in the project, and what is wrong."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_CONFIG))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                got = config_text.package_config(r["path"], r["source"] or "")
                for p in got["packages"]:
                    status, _, at = config_text.resolve_package_uri(got, f"package:{p['name']}/x")
                    p["lib"] = at[: -len("/x")] if status == "resolved" and at and at.endswith("/x") else None
                rows.append({"project_id": r["project_id"], **got})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = inputs.where("kind = 'package_config'").select(F.col("project_id").cast("string").alias("project_id"), "path", "source")
    return files.mapInArrow(run, _CONFIG)


def package_configs(inputs: DataFrame) -> DataFrame:
    """(project_id, scope, package, lib): where each package config puts each package's library directory.

    A config with errors has no package, but still is the nearest one of the files below it.
    """
    found = config_analyses(inputs)
    valid = (F.col("config_version") == config_text.SUPPORTED) & ~F.exists("diagnostics", lambda d: d["severity"] == "error")
    scope = paths.parent_column(paths.parent_column("path"))
    entries = F.when(valid, F.col("packages")).otherwise(F.array().cast("array<struct<name: string, root_uri: string, package_uri: string, language_version: string, lib: string>>"))
    return found.select("project_id", scope.alias("scope"), F.explode_outer(entries).alias("p")).select("project_id", "scope", F.col("p.name").alias("package"), F.col("p.lib").alias("lib"))


def _condition(c: Column) -> Column:
    """(key, expected) of a configurable URI's condition."""
    key = F.regexp_replace(F.split(c, "==", 2)[0], r"\s", "")
    value = F.regexp_extract(F.trim(F.split(c, "==", 2)[1]), r"^(['\"])(.*)\1$", 2)
    return F.struct(key.alias("key"), F.when(c.contains("=="), value).otherwise("true").alias("value"))


def uri_edges(facts: DataFrame, inputs: DataFrame, environment: dict[str, str] | None = None) -> DataFrame:
    """An edge for each import, export and part: kind, resolution and target.

    Without an environment an edge stands for each branch of a configurable URI, with one only for the
    branch that holds.
    """
    none = F.lit(None).cast("string")
    d = facts.select("project_id", F.col("path").alias("source_path"), F.explode("directives").alias("d"))
    every = F.concat(F.array(F.struct(none.alias("condition"), F.col("d.uri").alias("uri"))), F.transform("d.configurations", lambda c: F.struct(c["condition"].alias("condition"), c["uri"].alias("uri"))))
    if environment is not None:
        env = F.create_map(*[F.lit(x) for kv in environment.items() for x in kv]) if environment else F.create_map().cast("map<string,string>")
        holds = F.filter("d.configurations", lambda c: F.coalesce(env[_condition(c["condition"])["key"]] == _condition(c["condition"])["value"], F.lit(False)))
        first = F.transform(F.slice(holds, 1, 1), lambda c: F.struct(c["condition"].alias("condition"), c["uri"].alias("uri")))
        every = F.when(F.size(first) > 0, first).otherwise(F.slice(every, 1, 1))
    named = d.select("project_id", "source_path", F.col("d.kind").alias("kind"), F.explode(every).alias("u"), F.col("d.span").alias("span"), F.col("d.prefix").alias("prefix"), F.col("d.is_deferred").alias("is_deferred"), F.col("d.combinators").alias("combinators"))
    parts = facts.select("project_id", F.col("path").alias("source_path"), F.explode("parts").alias("p"))
    parts = parts.select("project_id", "source_path", F.lit("part").alias("kind"), F.struct(none.alias("condition"), F.col("p.uri").alias("uri")).alias("u"), F.col("p.span").alias("span"), none.alias("prefix"), F.lit(False).alias("is_deferred"), F.lit(None).cast("array<struct<kind: string, names: array<string>>>").alias("combinators"))
    edges = named.unionByName(parts).select("project_id", "source_path", "kind", "u.condition", "u.uri", "span", "prefix", "is_deferred", "combinators").withColumn("class", paths.uri_class(F.col("uri")))
    edges = written(edges.withColumn("edge", F.monotonically_increasing_id()), "edges")  # from here on an edge keeps its number

    relative = edges.where("class = 'relative'").select("edge", "project_id", paths.joined_column(paths.parent_column("source_path"), F.col("uri")).alias("target_path"))
    package = edges.where("class = 'package'").select("edge", "project_id", "source_path", F.regexp_extract("uri", "^package:([^/]*)", 1).alias("package"), F.regexp_extract("uri", "^package:[^/]*/(.*)$", 1).alias("rest"))
    configs = package_configs(inputs)
    scopes = configs.select("project_id", "scope").distinct()
    up = package.select("edge", "project_id", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("source_path", "/")) - 1), lambda k: F.struct(F.array_join(F.slice(F.split("source_path", "/"), 1, k), "/").alias("scope"), k.alias("depth")))).alias("s"))
    nearest = up.select("edge", "project_id", F.col("s.scope").alias("scope"), F.col("s.depth").alias("depth")).join(scopes, ["project_id", "scope"]).groupBy("edge").agg(F.max_by("scope", "depth").alias("scope"))
    scoped = package.join(nearest, "edge", "left")
    by_config = scoped.where("scope is not null").join(configs, ["project_id", "scope", "package"], "left")
    by_config = by_config.groupBy("edge", "project_id").agg(F.collect_set(paths.joined_column(F.col("lib"), F.col("rest"))).alias("found"))
    roots = package_roots(inputs)
    by_pubspec = scoped.where("scope is null").join(roots, ["project_id", "package"], "left")
    by_pubspec = by_pubspec.groupBy("edge", "project_id").agg(F.array_sort(F.collect_set(F.when(F.col("rest") != "", paths.joined_column(paths.joined_column(F.col("root"), F.lit("lib")), F.col("rest"))))).alias("found"))
    packaged = by_config.unionByName(by_pubspec)  # a package has few roots
    targets = relative.select("edge", "project_id", "target_path", F.array().cast("array<string>").alias("found")).unionByName(packaged.select("edge", "project_id", F.when(F.size("found") == 1, F.col("found")[0]).alias("target_path"), "found"))
    known = facts.select("project_id", F.col("path").alias("target_path")).distinct().withColumn("known", F.lit(True))
    resolved = targets.join(known, ["project_id", "target_path"], "left").drop("project_id")
    resolution = (
        F.when(F.col("class") == "dart", "external")
        .when(F.col("class") == "other", "unsupported_scheme")
        .when(F.size("found") > 1, "ambiguous_package")
        .when(F.col("target_path").isNull(), "unindexed_package")
        .when(F.col("known"), "resolved")
        .otherwise("missing_target")
    )
    candidates = F.when(F.size("found") > 1, F.col("found")).otherwise(F.array().cast("array<string>"))
    return edges.join(resolved, "edge", "left").withColumn("resolution", resolution).withColumn("candidate_paths", candidates).drop("class", "found", "known", "edge")


def part_links(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each part of each owner, and whether the part names the owner back."""
    parts = edges.where("kind = 'part'").select("project_id", F.col("source_path").alias("owner_path"), F.col("uri").alias("part_uri"), F.col("target_path").alias("part_path"), "resolution", "span")
    owners = facts.select("project_id", F.col("path").alias("owner_path"), F.col("library").alias("owner_name"))
    backs = facts.select("project_id", F.col("path").alias("part_path"), "part_of_uri", "part_of_name")
    j = parts.join(owners, ["project_id", "owner_path"], "left").join(backs, ["project_id", "part_path"], "left")
    back = F.when(F.col("part_of_uri").startswith("package:"), F.lit(None)).otherwise(paths.joined_column(paths.parent_column("part_path"), F.col("part_of_uri")))
    named = F.col("part_of_uri").isNotNull() | F.col("part_of_name").isNotNull()
    matches = (back == F.col("owner_path")) | (F.col("part_of_name") == F.col("owner_name"))
    status = F.when(F.col("resolution") != "resolved", "missing_part").when(~named, "missing_part_of").when(F.coalesce(matches, F.lit(False)), "matched").otherwise("owner_mismatch")
    return j.select("project_id", "owner_path", "part_uri", "part_path", F.coalesce("part_of_uri", "part_of_name").alias("declared_owner"), status.alias("status"), "span")


def owners(facts: DataFrame, links: DataFrame) -> DataFrame:
    """(project_id, path, owner): a matched part of a sole owner belongs to it, a contested one to nobody, all others to themselves."""
    j = facts.select("project_id", "path").join(_claims(links), ["project_id", "path"], "left")
    return j.select("project_id", "path", _owner("path").alias("owner"))


def _claims(links: DataFrame) -> DataFrame:
    """(project_id, path, lo, hi): the first and last owner of each matched part."""
    return links.where("status = 'matched'").groupBy("project_id", F.col("part_path").alias("path")).agg(F.min("owner_path").alias("lo"), F.max("owner_path").alias("hi"))


def _owner(path: str) -> Column:
    """The owner of a file that was joined to its claims, if it has any."""
    return F.when(F.col("lo").isNull(), F.col(path)).when(F.col("lo") == F.col("hi"), F.col("lo"))


def _lets_through(name: Column, combinators: Column) -> Column:
    return F.coalesce(F.forall(combinators, lambda c: F.when(c["kind"] == "show", F.array_contains(c["names"], name)).otherwise(~F.array_contains(c["names"], name))), F.lit(True))


def resolve(facts: DataFrame, edges: DataFrame, queries: DataFrame, resolved_only: bool = False) -> DataFrame:
    """queries (project_id, source_path, name, prefix) with status, basis and the sole candidate; other columns are kept.

    A declaration of the same file comes first, then of the same library, then what imports make visible,
    through exports with their show and hide; the first of these that has any decides.
    Each query meets its own file once, which decides those of the same file; the others look up libraries
    of several files, imports and names that are declared anywhere, by equi-joins whose small sides are tables of their own.
    Queries with ``own`` come from files of facts and know the ids of the declarations there; they meet only the parts that have an owner.
    resolved_only: rows of other statuses are left out, and so is what tells those apart.
    """
    more = [c for c in queries.columns if c not in ("project_id", "source_path", "name", "prefix", "own")]
    claims = written(_claims(part_links(facts, edges)), "library-claims")
    of = lambda c: claims.withColumnRenamed("path", c)
    files = facts.select("project_id", "path", "declarations").join(claims, ["project_id", "path"], "left").withColumn("owner", _owner("path"))
    decls = written(files.select("project_id", "path", "owner", F.explode("declarations").alias("d")).select("project_id", "path", "owner", "d.name", "d.symbol_id"), "declared")
    if "own" in queries.columns:
        home = queries.join(of("source_path"), ["project_id", "source_path"], "left").withColumn("home", _owner("source_path")).withColumn("is_file", F.lit(True)).drop("lo", "hi")
    else:
        named = F.transform("declarations", lambda d: F.struct(d["name"].alias("name"), d["symbol_id"].alias("symbol_id"))).alias("declarations")
        at_home = files.select("project_id", F.col("path").alias("source_path"), F.col("owner").alias("home"), named, F.lit(True).alias("is_file"))
        own = F.array_distinct(F.transform(F.filter("declarations", lambda d: F.col("prefix").isNull() & (d["name"] == F.col("name"))), lambda d: d["symbol_id"]))
        home = queries.join(at_home, ["project_id", "source_path"], "left").withColumn("own", F.coalesce(own, F.array().cast("array<string>"))).drop("declarations")
    several = claims.where("lo = hi and lo <> path").select("project_id", F.col("lo").alias("owner")).distinct()
    used = edges.where("resolution = 'resolved' and condition is null")
    imports = used.where("kind = 'import'").join(of("source_path"), ["project_id", "source_path"], "left").select(
        "project_id", _owner("source_path").alias("home"), F.col("prefix").alias("i_prefix"), "is_deferred", "combinators", F.col("target_path").alias("node")
    )
    imports = written(imports, "imports")
    settled = home.where(F.size("own") == 1)
    if resolved_only:  # a name that is not its file's can only come from a library of several files or by an import
        able = written(several.withColumnRenamed("owner", "home").union(imports.select("project_id", "home")).distinct(), "able")
        home = home.where(F.size("own") == 0).join(able, ["project_id", "home"], "left_semi").select(*home.columns)
    home = written(home.withColumn("q", F.monotonically_increasing_id()), "symbol-queries")
    open_ = home.where((F.size("own") == 0) & F.col("home").isNotNull())
    shared = written(decls.join(several, ["project_id", "owner"]).select("project_id", "name", F.col("owner").alias("home"), "path", "symbol_id"), "shared")
    fellow = open_.where("prefix is null").join(shared, ["project_id", "name", "home"]).where(F.col("path") != F.col("source_path")).select("q", F.lit(1).alias("tier"), "symbol_id", F.lit("same_library").alias("basis"))
    starts = open_.where(~F.col("name").startswith("_")).join(imports, ["project_id", "home"]).where(F.col("prefix").eqNullSafe(F.col("i_prefix")) & (F.col("prefix").isNotNull() | ~F.col("is_deferred")) & _lets_through(F.col("name"), F.col("combinators")))
    exports = written(used.where("kind = 'export'").select("project_id", F.col("source_path").alias("src"), F.col("target_path").alias("dst"), "combinators"), "exports")
    roots = written(starts.select("project_id", "q", "name", "node").distinct(), "import-roots")
    seen = graphs.reachable(exports, roots, ["project_id", "q", "name"], allow=_lets_through(F.col("name"), F.col("combinators")))
    found = seen.join(decls, (seen["project_id"] == decls["project_id"]) & (seen["name"] == decls["name"]) & (seen["node"] == decls["owner"]))
    brought = found.select("q", F.lit(2).alias("tier"), "symbol_id", F.when(F.col("depth") == 0, "direct_import").otherwise("re_export").alias("basis"))
    each = fellow.unionByName(brought).groupBy("q", "tier", "symbol_id").agg(F.min("basis").alias("basis"))  # direct_import sorts before re_export
    counted = each.groupBy("q", "tier").agg(F.count("*").alias("n"), F.min(F.struct("symbol_id", "basis")).alias("c"))
    best = written(counted.groupBy("q").agg(F.min(F.struct("tier", "n", "c")).alias("b")), "best")
    if resolved_only:
        one = home.join(best, "q").where("b.n = 1").select("project_id", "source_path", "name", "prefix", F.lit("resolved").alias("status"), F.col("b.c.basis").alias("basis"), F.col("b.c.symbol_id").alias("symbol_id"), *more)
        return settled.select("project_id", "source_path", "name", "prefix", F.lit("resolved").alias("status"), F.lit("same_file").alias("basis"), F.get("own", F.lit(0)).alias("symbol_id"), *more).union(one)
    asked = home.where(F.size("own") == 0).select("project_id", "name").distinct()
    anywhere = written(decls.select("project_id", "name").distinct().join(asked, ["project_id", "name"], "left_semi").withColumn("anywhere", F.lit(True)), "named-anywhere")
    out = home.join(best, "q", "left").join(anywhere, ["project_id", "name"], "left")
    n = F.when(F.size("own") > 0, F.size("own")).otherwise(F.col("b.n"))
    status = F.when(F.col("is_file").isNull(), "source_file_missing").when(n == 1, "resolved").when(n > 1, "ambiguous").when(F.col("anywhere"), "not_visible").otherwise("missing")
    basis = F.when(F.size("own") > 0, "same_file").otherwise(F.col("b.c.basis"))
    symbol = F.coalesce(F.get("own", F.lit(0)), F.col("b.c.symbol_id"))
    return out.select("project_id", "source_path", "name", "prefix", status.alias("status"), F.when(n == 1, basis).alias("basis"), F.when(n == 1, symbol).alias("symbol_id"), *more)


def summary(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of a project's files and facts."""
    n = lambda c: F.sum(F.size(c)).alias(f"n_{c}")
    of = facts.groupBy("project_id").agg(F.count("*").alias("n_files"), n("directives"), n("parts"), n("declarations"), n("constants"), n("diagnostics"))
    links = edges.groupBy("project_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("resolution") == "resolved").alias("n_resolved"))
    return of.join(links, "project_id", "left")


_LINT = "project_id", "rule_id", "severity", "message", "path", "span", "related_paths"


def lint(facts: DataFrame, edges: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Findings of the enabled rules, each once. config: enabled_rules, severity_overrides, forbidden_imports
    ({pattern, kind}), layer_boundaries ({source, target}), naming ({ignored_prefixes}), orphan_files ({entry_points}).

    Patterns and boundaries are a configuration and become expressions; no rule that is off is computed.
    """
    on = set(config.get("enabled_rules", ()))
    severity = lambda rule: F.lit(config.get("severity_overrides", {}).get(rule, "warning"))
    none = F.array().cast("array<string>")
    shape = lambda df, rule, message, path, span, related: df.select("project_id", F.lit(rule).alias("rule_id"), severity(rule).alias("severity"), message.alias("message"), path.alias("path"), span.alias("span"), related.alias("related_paths"))
    out: list[DataFrame] = []
    if "forbidden_import" in on and config.get("forbidden_imports"):
        uri = F.col("uri")
        hits = [F.when(uri.startswith(p["pattern"]) if p.get("kind") == "prefix" else uri == p["pattern"], F.lit(p["pattern"])) for p in config["forbidden_imports"]]
        found = edges.where("kind = 'import'").withColumn("pattern", F.explode(F.array_compact(F.array(*hits))))
        out.append(shape(found, "forbidden_import", F.concat(F.lit("import '"), uri, F.lit("' is forbidden by '"), "pattern", F.lit("'")), F.col("source_path"), F.col("span"), none))
    if "layer_boundary" in on and config.get("layer_boundaries"):
        deny = [F.when(F.col("source_path").startswith(b["source"]) & F.col("target_path").startswith(b["target"]), F.lit(b["target"])) for b in config["layer_boundaries"]]
        found = edges.where("resolution = 'resolved' and kind <> 'part'").withColumn("denied", F.array_min(F.array_compact(F.array(*deny)))).where("denied is not null")
        out.append(shape(found, "layer_boundary", F.concat(F.lit("must not depend on '"), "denied", F.lit("'")), F.col("source_path"), F.col("span"), F.array("target_path")))
    if "naming_convention" in on:
        ignored = config.get("naming", {}).get("ignored_prefixes", [])
        kept = facts
        for p in ignored:
            kept = kept.where(~F.col("path").startswith(p))
        plain = lambda c: c.rlike("^[\\x00-\\x7F]*$")
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.dart$", "")
        files = kept.where(plain(stem) & ~stem.rlike(r"^_*[a-z][a-z0-9]*(_[a-z0-9]+)*(\.[a-z0-9_]+)*$"))
        out.append(shape(files, "naming_convention", F.lit("file name is not lower_snake_case"), F.col("path"), F.lit(None).cast(_SPAN), none))
        d = kept.select("project_id", "path", F.explode("declarations").alias("d")).select("project_id", "path", "d.*")
        types = d.where(F.col("kind").isin("class", "mixin", "enum", "extension_type", "typedef") & plain(F.col("name")) & ~F.col("name").rlike("^_*[A-Z][A-Za-z0-9]*$"))
        values = d.where(F.col("kind").isin("function", "variable") & plain(F.col("name")) & ~F.col("name").rlike("^_*[a-z][A-Za-z0-9]*$"))
        for found, what in ((types, "UpperCamelCase"), (values, "lowerCamelCase")):
            out.append(shape(found, "naming_convention", F.concat(F.lit("'"), "name", F.lit(f"' is not {what}")), F.col("path"), F.col("span"), none))
    if "unresolved_part" in on:
        links = part_links(facts, edges).where("status <> 'matched'")
        out.append(shape(links, "unresolved_part", F.concat(F.lit("part '"), "part_uri", F.lit("' is "), F.regexp_replace("status", "_", " ")), F.col("owner_path"), F.col("span"), F.array_compact(F.array("part_path"))))
    if "orphan_file" in on:
        entry = config.get("orphan_files", {}).get("entry_points", [])
        nodes = facts.select("project_id", F.col("path").alias("node"))
        links = written(edges.where("resolution = 'resolved'").select("project_id", F.col("source_path").alias("src"), F.col("target_path").alias("dst")).distinct(), "lint-edges")
        orphans = graphs.unreachable(nodes, links, nodes.where(F.col("node").isin(entry)), ["project_id"])
        out.append(shape(orphans, "orphan_file", F.lit("no entry point reaches this file"), F.col("node"), F.lit(None).cast(_SPAN), none))
    if not out:
        return facts.sparkSession.createDataFrame([], f"project_id string, rule_id string, severity string, message string, path string, span {_SPAN}, related_paths array<string>")
    total = out[0]
    for more in out[1:]:
        total = total.union(more)
    return total.dropDuplicates(list(_LINT))


def envelope(rows: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """keys and a versioned JSON document of each row, with nulls written out."""
    data = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.select(*keys, F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(1).alias("version"), data.alias("data")), {"ignoreNullFields": "false"}).alias("json"))


def sarif_results(findings: DataFrame, rules: list[str]) -> DataFrame:
    """A SARIF 2.1.0 result in JSON for each finding, for a sink that streams them into one run."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    order = {r: k for k, r in enumerate(sorted(rules))}
    index = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("rule_id")]
    region = F.when(F.col("span").isNotNull(), F.struct(F.col("span.start_line").alias("startLine"), F.col("span.start_column").alias("startColumn"), F.col("span.end_line").alias("endLine"), F.col("span.end_column").alias("endColumn")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    related = F.transform("related_paths", lambda p: F.struct(F.struct(F.struct(p.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), index.alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), related.alias("relatedLocations"))
    return findings.select("project_id", "path", F.col("span.byte_start").alias("byte_start"), F.to_json(result).alias("json"))


def sarif(results: list[str], rules: list[str], tool: str = "braidwork") -> str:
    """One SARIF document of one project's results (in order), of a size that its input budget bounds."""
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in sorted(rules)]}}, "columnKind": "unicodeCodePoints", "results": [json.loads(r) for r in results]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, ensure_ascii=False)
