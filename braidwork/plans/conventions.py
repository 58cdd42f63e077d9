"""What calls say by convention: assets, routes, localizations, themes; and what names refer to."""

from __future__ import annotations

from collections.abc import Callable, Collection

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import calls_text
from ..tables import written
from . import assets
from .code import _FACTS, _SPAN

_ARGUMENT = "struct<name: string, expression: string, string_value: string, map_entries: array<struct<key: string, string_key: string, value: string, byte_start: long, byte_end: long>>, byte_start: long, byte_end: long>"
_SCHEMA = (
    "project_id string, path string, "
    f"members array<struct<name: string, kind: string, symbol_id: string, parent_symbol_id: string, extends: string, is_static: boolean, declaration_span: {_SPAN}>>, "
    f"bindings array<struct<name: string, kind: string, symbol_id: string, enclosing_symbol_id: string, declaration_span: {_SPAN}, scope_start: long, scope_end: long>>, "
    f"invocations array<struct<target: string, arguments: array<{_ARGUMENT}>, result_members: array<string>, enclosing_symbol_id: string, span: {_SPAN}>>, "
    f"references array<struct<name: string, prefix: string, kind: string, confidence: string, enclosing_symbol_id: string, span: {_SPAN}>>, "
    f"problems array<struct<code: string, severity: string, span: {_SPAN}>>, "
    "names array<struct<name: string, prefix: string, n: int, own: array<string>, places: array<struct<byte_start: long, kind: string>>>>"
)


def code_facts(inputs: DataFrame, parser: Callable[[str, str], dict] | None = None, only: Collection[str] = calls_text.FIELDS, lines: bool = True) -> DataFrame:
    """Members, bindings, invocations and references of each Dart file, in one pass over it.

    only: the fields that are wanted, those of code.extracted too; ``invocations.target`` is one field of a list's structs.
    What is not wanted is not computed. Without lines, spans are byte ranges alone. parser: (path, source) -> facts, in place of this one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    every = StructType([*StructType.fromDDL(_SCHEMA).fields, *StructType.fromDDL(_FACTS).fields[2:]])
    shape = StructType([*every.fields[:2], *_pruned(StructType(every.fields[2:]), set(only), lines).fields])
    schema = to_arrow_schema(shape)
    parts = {".".join(f.split(".")[:n]) for f in only for n in (1, 2)}
    parse = parser or (lambda path, source: calls_text.wanted(path, source, parts, lines))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 100):
                rows = [{"project_id": r["project_id"], **parse(r["path"], r["source"] or "")} for r in batch.slice(lo, 100).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = inputs.where("kind = 'dart'").select(F.col("project_id").cast("string").alias("project_id"), "path", "source")
    return files.mapInArrow(run, shape)


def _pruned(shape: StructType, only: set[str], lines: bool) -> StructType:
    """shape with the fields that only names, by their dotted paths; a field named without any below it is whole."""
    out = StructType()
    for f in shape.fields:
        below = {o.split(".", 1)[1] for o in only if o.startswith(f"{f.name}.")}
        if only and f.name not in only and not below:
            continue
        inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        if isinstance(inner, StructType):
            inner = StructType(inner.fields[:2]) if not lines and inner.names[:2] == ["byte_start", "byte_end"] else _pruned(inner, below, lines)
            out.add(f.name, ArrayType(inner) if isinstance(f.dataType, ArrayType) else inner)
        else:
            out.add(f)
    return out


def members(code: DataFrame) -> DataFrame:
    """A row for each declaration, members and locals included."""
    return code.select("project_id", "path", F.explode("members").alias("m")).select("project_id", "path", "m.*")


def invocations(code: DataFrame) -> DataFrame:
    return code.select("project_id", "path", F.explode("invocations").alias("c")).select("project_id", "path", "c.*")


def references(code: DataFrame) -> DataFrame:
    return code.select("project_id", "path", F.explode("references").alias("r")).select("project_id", "path", "r.*")


def bindings(code: DataFrame) -> DataFrame:
    return code.select("project_id", "path", F.explode("bindings").alias("b")).select("project_id", "path", "b.*")


def _positional(k: int) -> Column:
    return F.get(F.filter("arguments", lambda a: a["name"].isNull()), F.lit(k))


def _named(name: str) -> Column:
    return F.get(F.filter("arguments", lambda a: a["name"] == name), F.lit(0))


# The calls that name assets, routes and themes.
ASSET_TARGETS = assets.ASSET_CALLS | {"DefaultAssetBundle.of.loadString": "default_asset_bundle_load_string"}
NAVIGATOR = [
    "pushNamed", "pushReplacementNamed", "pushNamedAndRemoveUntil", "popAndPushNamed",
    "restorablePushNamed", "restorablePushReplacementNamed", "restorablePushNamedAndRemoveUntil", "restorablePopAndPushNamed",
]
APPLICATIONS = ["MaterialApp", "WidgetsApp"]
OFFICIAL = ["package:flutter/material.dart", "package:flutter/widgets.dart", "package:flutter/cupertino.dart"]
THEMES = {"ThemeData": "theme_data", "ThemeData.light": "theme_data_light", "ThemeData.dark": "theme_data_dark", "ThemeData.from": "theme_data_from"}
THEME_SLOTS = {
    "theme": "material_app_theme", "darkTheme": "material_app_dark_theme", "highContrastTheme": "material_app_high_contrast_theme",
    "highContrastDarkTheme": "material_app_high_contrast_dark_theme", "themeMode": "material_app_theme_mode",
}


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def asset_uses(code: DataFrame) -> DataFrame:
    """(project_id, path, source, asset, package, package_expression, byte_start) of the calls that name an asset by a literal."""
    calls = invocations(code).withColumn("source", _mapped(ASSET_TARGETS, F.col("target"))).where("source is not null")
    package = _named("package")
    out = calls.select("project_id", "path", "source", _positional(0)["string_value"].alias("asset"), package["string_value"].alias("package"), F.when(package["string_value"].isNull(), package["expression"]).alias("package_expression"), F.col("span.byte_start").alias("byte_start"))
    return out.where("asset is not null")


def localization_uses(code: DataFrame, name: str = "AppLocalizations") -> DataFrame:
    """(project_id, path, key, byte_start): the messages that are read from a localization class."""
    calls = invocations(code).where((F.col("target") == f"{name}.of") | F.col("target").startswith(f"{name}.of."))
    key = F.when(F.col("target") == f"{name}.of", F.get("result_members", F.lit(0))).otherwise(F.substring_index("target", ".", -1))
    return calls.select("project_id", "path", key.alias("key"), F.col("span.byte_start").alias("byte_start")).where("key is not null")


def _interpolated(text: Column, constants: Column) -> Column:
    """text with $name and ${name} replaced by constants of the same file; null if one is not known."""
    mark = r"\$(?:\{[A-Za-z0-9_]+\}|[A-Za-z0-9_]+|)"
    names = F.regexp_extract_all(text, F.lit(r"\$(\{[A-Za-z0-9_]+\}|[A-Za-z0-9_]+|)"), 1)
    values = F.transform(names, lambda n: constants[F.regexp_replace(n, r"[{}]", "")])
    pieces = F.split(text, mark, -1)
    whole = F.transform(pieces, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.get(values, k - 1), p)))
    return F.when(~F.exists(whole, lambda w: w.isNull()), F.array_join(whole, ""))


def routes(code: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(project_id, path, constructor, route, kind, resolved, confidence, byte_start) of the calls that name a route.

    Without facts, code has the directives and constants of its files too.
    """
    constants = F.map_from_entries(F.transform("constants", lambda c: F.struct(c["name"], c["value"])))
    official = F.exists("directives", lambda d: (d["kind"] == "import") & d["uri"].isin(OFFICIAL)).alias("official")
    named = F.filter("invocations", lambda c: F.substring_index(c["target"], ".", -1).isin("GoRoute", "Navigator", *APPLICATIONS, *NAVIGATOR)).alias("invocations")
    if facts is None:
        files = code.select("project_id", "path", named, official, "constants").where(F.size("invocations") > 0)
    else:
        files = code.select("project_id", "path", named).where(F.size("invocations") > 0).join(facts.select("project_id", "path", official, "constants"), ["project_id", "path"])
    known = files.withColumn("constants", F.expr("transform(constants, (c, k) -> if(exists(slice(constants, k + 2, size(constants)), o -> o.name = c.name), null, c))")).withColumn("constants", F.array_compact("constants"))
    calls = known.select("project_id", "path", "official", constants.alias("known"), F.explode("invocations").alias("c")).select("project_id", "path", "official", "known", "c.*")
    last = F.substring_index("target", ".", -1)
    parts = F.split("target", r"\.")
    at = F.size(parts) - F.array_position(F.reverse(parts), "Navigator") + 1  # behind the last Navigator
    of = F.element_at(parts, (at + 1).cast("int")) == "of"
    step = F.size(parts) - at
    pushed = F.when((step == 2) & F.try_element_at(parts, (at + 1).cast("int")).eqNullSafe("of"), _positional(0)).when(step == 1, _positional(1))
    del of
    app = F.col("official") & last.isin(APPLICATIONS)
    value = lambda a, c: F.struct(F.lit(c).alias("constructor") if isinstance(c, str) else c.alias("constructor"), a["string_value"].alias("literal"), a["expression"].alias("expression"), a["byte_start"].alias("byte_start"))
    fixed = lambda c, text, start: F.struct(c.alias("constructor"), text.alias("literal"), text.alias("expression"), start.alias("byte_start"))
    table = F.transform(_named("routes")["map_entries"], lambda e: fixed(F.concat(last, F.lit(".routes")), e["string_key"], e["byte_start"]))
    some = lambda cond, v: F.when(cond, F.array(v)).otherwise(F.array().cast("array<struct<constructor:string,literal:string,expression:string,byte_start:bigint>>"))
    navigator = F.col("official") & last.isin(NAVIGATOR) & F.array_contains(parts, "Navigator")
    name = F.when(F.array_contains(parts, "of"), F.concat(F.lit("Navigator.of."), last)).otherwise(F.concat(F.lit("Navigator."), last))
    initial = F.col("official") & last.isin([*APPLICATIONS, "Navigator"]) & _named("initialRoute").isNotNull()
    every = F.concat(
        some((F.col("target") == "GoRoute") & _named("path").isNotNull(), value(_named("path"), "GoRoute")),
        F.when(app & _named("routes").isNotNull(), F.filter(table, lambda e: e["literal"].isNotNull())).otherwise(F.array().cast("array<struct<constructor:string,literal:string,expression:string,byte_start:bigint>>")),
        some(app & _named("home").isNotNull(), fixed(F.concat(last, F.lit(".home")), F.lit("/"), _named("home")["byte_start"])),
        some(initial, value(_named("initialRoute"), F.concat(last, F.lit(".initialRoute")))),
        some(navigator & pushed.isNotNull(), value(pushed, name)),
    )
    r = calls.select("project_id", "path", "known", F.explode(every).alias("r")).select("project_id", "path", "known", "r.*")
    literal, dollar = F.col("literal"), F.col("literal").contains("$")
    resolved = F.when(literal.isNull(), F.col("known")[F.col("expression")]).when(dollar, _interpolated(literal, F.col("known"))).otherwise(literal)
    kind = F.when(literal.isNotNull() & ~dollar, "literal").otherwise("expression")
    r = r.select("project_id", "path", "constructor", F.coalesce(literal, "expression").alias("route"), kind.alias("kind"), resolved.alias("resolved"), "byte_start", dollar.alias("dollar"))
    return r.withColumn("confidence", F.when(F.col("dollar") & F.col("resolved").isNull(), "medium").otherwise("high")).drop("dollar").distinct()


def themes(code: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(project_id, path, kind, expression, byte_start): themes made, and the slots that take them, in files that import material.

    Without facts, code has the directives of its files too.
    """
    material = F.exists("directives", lambda d: (d["kind"] == "import") & (d["uri"] == OFFICIAL[0]))
    if facts is None:
        calls = invocations(code.where(material))
    else:
        calls = invocations(code).join(facts.where(material).select("project_id", "path"), ["project_id", "path"], "left_semi")
    parts = F.split("target", r"\.")
    n = F.size(parts)
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    none = F.lit(None).cast("string")
    row = lambda kind, expression, start: F.struct(kind.alias("kind"), expression.alias("expression"), start.alias("byte_start"))
    made = F.array(row(F.coalesce(_mapped(THEMES, tail(2)), _mapped(THEMES, tail(1))), none, F.col("span.byte_start")))
    app = (tail(1) == "MaterialApp") | (tail(2) == "MaterialApp.router")
    slots = F.transform(F.when(app, F.col("arguments")), lambda a: row(_mapped(THEME_SLOTS, a["name"]), a["expression"], a["byte_start"]))
    data = _named("data")
    datas = F.array(F.when(data.isNotNull(), row(_mapped({"Theme": "theme_data_slot", "AnimatedTheme": "animated_theme_data_slot"}, tail(1)), data["expression"], data["byte_start"])))
    found = F.filter(F.concat(made, F.coalesce(slots, F.array()), datas), lambda t: t["kind"].isNotNull())
    return calls.select("project_id", "path", F.explode(found).alias("t")).select("project_id", "path", "t.kind", "t.expression", "t.byte_start")


def inventory(code: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """How many widgets, routes, assets and localizations a project has; without facts, code has what code.extracted gives too."""
    facts_ = code if facts is None else facts
    each = [("flutter_widgets", assets.widgets(facts_)), ("flutter_routes", routes(code, facts)), ("flutter_assets", asset_uses(code)), ("flutter_localizations", localization_uses(code))]
    total = None
    for name, df in each:
        one = df.select("project_id", F.lit(name).alias("what"))
        total = one if total is None else total.union(one)
    counts = total.groupBy("project_id").agg(*(F.count_if(F.col("what") == name).alias(name) for name, _ in each))
    return facts_.select("project_id").distinct().join(counts, "project_id", "left").na.fill(0)


def bound_references(code: DataFrame) -> DataFrame:
    """Reads and writes with the innermost binding of the name at their place: (project_id, path, name, kind, byte_start, status, symbol_id).

    Both are of one file, so each row of code answers for itself; nothing is joined. Equal scopes and declarations are ambiguous.
    """
    uses = F.filter("references", lambda r: r["kind"].isin("variable_read", "variable_write"))
    r = code.where(F.size(uses) > 0).select("project_id", "path", "bindings", F.explode(uses).alias("r"))
    r = r.select("project_id", "path", F.col("r.name").alias("name"), F.col("r.kind").alias("kind"), F.col("r.span.byte_start").alias("byte_start"), "bindings")
    at = F.col("byte_start")
    inside = F.filter("bindings", lambda b: (b["name"] == F.col("name")) & (b["scope_start"] <= at) & (at < b["scope_end"]))
    rank = lambda b: F.struct((b["scope_end"] - b["scope_start"]).alias("length"), (-b["declaration_span"]["byte_start"]).alias("late"))
    r = r.withColumn("found", F.transform(inside, lambda b: F.struct(rank(b).alias("rank"), b["symbol_id"].alias("symbol_id")))).where(F.size("found") > 0)
    best = F.filter("found", lambda f: f["rank"] == F.array_min("found")["rank"])
    r = r.select("project_id", "path", "name", "kind", "byte_start", best.alias("best"))
    one = F.size("best") == 1
    return r.select("project_id", "path", "name", "kind", "byte_start", F.when(one, "resolved").otherwise("ambiguous").alias("status"), F.when(one, F.get("best", F.lit(0))["symbol_id"]).alias("symbol_id"))


def definitions(code: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """The declaration that each namespace reference means: (project_id, path, byte_start, name, prefix, kind, status, basis, symbol_id). code: facts with ``names``."""
    from . import code as linking

    found = linking.resolve(facts, edges, _asked(code, "places")).withColumn("p", F.explode("places"))
    return found.select("project_id", F.col("source_path").alias("path"), "p.byte_start", "name", "prefix", "p.kind", "status", "basis", "symbol_id")


def resolved_names(code: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """definitions that are resolved, a row for each name of a file with their number: (project_id, path, name, prefix, n, status, basis, symbol_id)."""
    from . import code as linking

    found = linking.resolve(facts, edges, _asked(code, "n"), resolved_only=True)
    return found.select("project_id", F.col("source_path").alias("path"), "name", "prefix", "n", "status", "basis", "symbol_id")


def _asked(code: DataFrame, *more: str) -> DataFrame:
    """The names of each file, each asked for once; those that it declares itself are known from its own text."""
    return code.select("project_id", "path", F.explode("names").alias("a")).select("project_id", F.col("path").alias("source_path"), "a.name", "a.prefix", "a.own", *(f"a.{c}" for c in more))


def constructors(code: DataFrame) -> DataFrame:
    """(project_id, owner, constructor, symbol_id, implicit): the constructors of each class; one without any has an unnamed one of its own."""
    m = F.col("members")
    own = lambda o: F.transform(F.filter(m, lambda c: (c["kind"] == "constructor") & (c["parent_symbol_id"] == o["symbol_id"])), lambda c: F.struct(c["name"].alias("constructor"), c["symbol_id"].alias("symbol_id"), F.lit(False).alias("implicit")))
    implicit = lambda o: F.array(F.struct(o["name"].alias("constructor"), o["symbol_id"].alias("symbol_id"), F.lit(True).alias("implicit")))
    owners = code.select("project_id", "path", m, F.explode(F.filter(m, lambda o: o["kind"].isin("class", "extension_type", "enum"))).alias("o"))
    each = owners.select("project_id", "path", F.col("o.name").alias("owner"), own(F.col("o")).alias("own"), implicit(F.col("o")).alias("implicit"))
    each = each.select("project_id", "path", "owner", F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("implicit"))).alias("c"))
    return each.select("project_id", "path", "owner", "c.constructor", "c.symbol_id", "c.implicit")


def references_to(definitions_: DataFrame) -> DataFrame:
    """How often, and in how many files, each declaration is referred to, by references that mean it alone; a row of resolved_names counts for its n."""
    each = F.sum("n") if "n" in definitions_.columns else F.count("*")
    return definitions_.where("status = 'resolved'").groupBy("project_id", "symbol_id").agg(each.alias("n_references"), F.count_distinct("path").alias("n_files"))


def localization_keys(code: DataFrame, inputs: DataFrame) -> DataFrame:
    """Uses of messages with whether the project's template has them: (project_id, path, key, byte_start, code).

    inputs of kind ``l10n`` and ``arb`` are the explicit catalogs. The template is that of l10n.yaml, of the default where there is none.
    """
    from ..functions import config_text

    @F.udf("struct<template: string, class_name: string, problems: array<string>>")
    def configured(source: str | None):  # noqa: ANN202
        got, problems = config_text.l10n(source or "")
        return got["arb-dir"].rstrip("/") + "/" + got["template-arb-file"], got["output-class"], problems

    @F.udf("array<string>")
    def keys(source: str | None):  # noqa: ANN202
        return [k for k, _, _ in config_text.arb(source or "")[1]]

    l10n = inputs.where("kind = 'l10n'").groupBy("project_id").agg(F.min_by("source", "path").alias("source"))
    default = configured(F.lit(""))
    projects = inputs.select("project_id").distinct().join(l10n, "project_id", "left")
    projects = projects.select("project_id", F.coalesce(configured("source"), default)["template"].alias("template"))
    catalogs = inputs.where("kind = 'arb'").select("project_id", F.col("path").alias("template"), F.explode_outer(keys("source")).alias("key"))
    templates = projects.join(catalogs, ["project_id", "template"])
    have = templates.select("project_id").distinct().withColumn("has_template", F.lit(True))
    known = templates.select("project_id", "key").distinct().withColumn("known", F.lit(True))
    uses = localization_uses(code).join(have, "project_id", "left").join(known, ["project_id", "key"], "left")
    problem = F.when(F.col("has_template").isNull(), "flutter_l10n_template_missing").when(F.col("known").isNull(), "flutter_localization_key_missing")
    return uses.select("project_id", "path", "key", "byte_start", problem.alias("code"))


__all__ = ["asset_uses", "bound_references", "code_facts", "constructors", "definitions", "inventory", "localization_keys", "localization_uses", "members", "references", "references_to", "resolved_names", "routes", "themes", "written"]
