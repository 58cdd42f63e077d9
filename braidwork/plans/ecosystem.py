"""Packages whose conventions may be enabled: whether a project depends on a supported version, and where it uses them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
# Convention, package, supported range, version of the fixtures, supported majors, calls, base classes.
# A call that begins with BuildContext stands for that member of any receiver.
TABLE = [
    ("go_router", "go_router", ">=14.0.0 <18.0.0", "17.3.0", [14, 15, 16, 17], ["GoRouter", "GoRoute", "ShellRoute", "StatefulShellRoute", "StatefulShellBranch"], []),
    (
        "provider", "provider", ">=6.0.0 <7.0.0", "6.1.5+1", [6],
        ["Provider", "ChangeNotifierProvider", "MultiProvider", "ProxyProvider", "Consumer", "Selector", "BuildContext.watch", "BuildContext.read", "BuildContext.select"], [],
    ),
    ("flutter_riverpod", "flutter_riverpod", ">=2.0.0 <4.0.0", "3.3.2", [2, 3], ["ProviderScope", "Consumer"], ["ConsumerWidget", "ConsumerStatefulWidget", "ConsumerState"]),
    (
        "flutter_bloc", "flutter_bloc", ">=8.0.0 <10.0.0", "9.1.1", [8, 9],
        ["BlocProvider", "MultiBlocProvider", "BlocBuilder", "BlocListener", "BlocConsumer", "BlocSelector", "RepositoryProvider", "MultiRepositoryProvider"], [],
    ),
]
_NUMBERS = r"v*(\d{1,18})(?:\.(\d{1,18}))?(?:\.(\d{1,18}))?(?:[+-].*)?$"


def support_table(spark: SparkSession) -> DataFrame:
    """(convention, package, supported_range, fixture_version, patterns), one row for each convention."""
    rows = [(c, p, r, v, calls + bases) for c, p, r, v, _, calls, bases in TABLE]
    return spark.createDataFrame(rows, "convention string, package string, supported_range string, fixture_version string, patterns array<string>")


def _version(c: Column, prefix: str) -> Column:
    """(major, minor, patch) of a version after a prefix, null if it is none. What follows + or - is left out."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, prefix + _NUMBERS, k), F.lit("")), F.lit("0")).cast("long")
    return F.when(c.rlike(prefix + _NUMBERS), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def allows_major(constraint: Column, majors: list[int]) -> Column:
    """Whether a version constraint has a version of one of the majors in common with them; null where it can't be told.

    A caret or a bare version stands for its major. Otherwise the comparators bound an interval; a bound is a version
    and the side of it on which the interval ends, so that an interval is empty just if its ends do not ascend.
    """
    c = F.trim(constraint)
    alone = F.coalesce(_version(c, r"^\^"), F.when(~c.rlike(r"\s|^[<>=]"), _version(c, "^")))
    words = F.filter(F.split(F.translate(c, ",", " "), r"\s+"), lambda w: w != "")
    bounds = F.transform(words, lambda w: F.struct(F.regexp_extract(w, "^(>=|<=|>|<|=|)", 1).alias("op"), _version(w, "^(?:>=|<=|>|<|=|)").alias("v")))
    end = lambda v, side: F.struct(v.alias("v"), F.lit(side).alias("side"))
    whole = lambda major: F.struct(F.lit(major).cast("long").alias("major"), F.lit(0).cast("long").alias("minor"), F.lit(0).cast("long").alias("patch"))

    def meets(major: int) -> Column:
        lows = F.transform(F.filter(bounds, lambda b: b["op"].isin(">", ">=", "=", "")), lambda b: F.struct(b["v"].alias("v"), F.when(b["op"] == ">", 1).otherwise(0).alias("side")))
        highs = F.transform(F.filter(bounds, lambda b: b["op"].isin("<", "<=", "=", "")), lambda b: F.struct(b["v"].alias("v"), F.when(b["op"] == "<", 0).otherwise(1).alias("side")))
        low = F.array_max(F.concat(lows, F.array(end(whole(major), 0))))
        high = F.array_min(F.concat(highs, F.array(end(whole(major + 1), 0))))
        return low < high

    known = (F.size(words) > 0) & F.forall(bounds, lambda b: b["v"].isNotNull())
    ranged = F.when(known, reduce(lambda a, b: a | b, map(meets, majors)))
    return F.when((c == "") | (c == "any") | c.contains("||"), F.lit(None)).when(alone.isNotNull(), alone["major"].isin(majors)).when(c.rlike(r"\s|^[<>=]"), ranged)


def evidence(specs: DataFrame) -> DataFrame:
    """(project_id, path, section, package, kind, version_constraint, byte_start, byte_end) of the dependencies on the table's packages."""
    d = specs.select("project_id", "path", F.explode("dependencies").alias("d")).where(F.col("d.name").isin([t[1] for t in TABLE]))
    constraint = F.when(F.col("d.kind").isin("version", "hosted"), F.coalesce(F.col("d.fields")["constraint"], F.col("d.fields")["version"]))
    return d.select("project_id", "path", "d.section", F.col("d.name").alias("package"), "d.kind", constraint.alias("version_constraint"), "d.byte_start", "d.byte_end").distinct()


def statuses(projects: DataFrame, specs: DataFrame, enabled: list[str]) -> DataFrame:
    """(project_id, convention, package, status) for each project and enabled convention.

    active: a dependency allows a supported version. unverifiable_version: else, one that does not tell. unsupported_version:
    else, there is one. dependency_missing: there is none.
    """
    table = [t for t in TABLE if t[0] in set(enabled)]
    if not table:
        return projects.select("project_id", F.lit("").alias("convention"), F.lit("").alias("package"), F.lit("").alias("status")).limit(0)
    entry = F.array(*[F.struct(F.lit(t[0]).alias("convention"), F.lit(t[1]).alias("package")) for t in table])
    every = projects.select("project_id").distinct().select("project_id", F.explode(entry).alias("e")).select("project_id", "e.*")
    fits = F.lit(None).cast("boolean")
    for _, package, _, _, majors, _, _ in table:
        fits = F.when(F.col("package") == package, allows_major(F.col("version_constraint"), majors)).otherwise(fits)
    seen = evidence(specs).withColumn("fits", fits).groupBy("project_id", "package").agg(F.bool_or(F.coalesce("fits", F.lit(False))).alias("some"), F.bool_or(F.col("fits").isNull()).alias("open"))
    status = F.when(F.col("some").isNull(), "dependency_missing").when(F.col("some"), "active").when(F.col("open"), "unverifiable_version").otherwise("unsupported_version")
    return every.join(seen, ["project_id", "package"], "left").select("project_id", "convention", "package", status.alias("status"))


def findings(facts: DataFrame, code: DataFrame, states: DataFrame) -> DataFrame:
    """(project_id, convention, path, pattern, kind, confidence, span): calls and base classes of active conventions, in files that import their package.

    facts: of code.extracted; code: of conventions.code_facts; states: of statuses.
    """
    active = states.where("status = 'active'").select("project_id", "convention", "package")
    imports = facts.select("project_id", "path", F.explode("directives").alias("d")).where("d.kind = 'import'")
    imports = imports.select("project_id", "path", F.regexp_extract("d.uri", "^package:([^/]+)/", 1).alias("package")).where(F.col("package").isin([t[1] for t in TABLE])).distinct()
    used = imports.join(active, ["project_id", "package"]).select("project_id", "path", "convention")
    member = "BuildContext."
    rows = [(t[0], kind, p.removeprefix(member), p, p.startswith(member)) for t in TABLE for kind, names in (("invocation", t[5]), ("base_class", t[6])) for p in names]
    patterns = F.broadcast(facts.sparkSession.createDataFrame(rows, "convention string, kind string, last string, pattern string, dotted boolean"))  # the table's, and no more
    calls = code.select("project_id", "path", F.explode("invocations").alias("c")).select("project_id", "path", F.lit("invocation").alias("kind"), F.col("c.target").alias("name"), "c.span")
    bases = facts.select("project_id", "path", F.explode("declarations").alias("d")).where("d.extends is not null").select("project_id", "path", F.lit("base_class").alias("kind"), F.col("d.extends").alias("name"), "d.span")
    named = calls.unionByName(bases).withColumn("last", F.substring_index("name", ".", -1))
    hits = named.join(patterns, ["kind", "last"]).where(~F.col("dotted") | F.col("name").contains("."))
    return hits.join(used, ["project_id", "path", "convention"]).select("project_id", "convention", "path", "pattern", "kind", F.lit("medium").alias("confidence"), "span").distinct()
