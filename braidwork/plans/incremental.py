"""What a new state of source trees changes: rebuild plans, affected paths and libraries, lints that are kept or computed again.

Both states are tables of facts and edges, as ``code.extracted`` and ``code.uri_edges`` give them. All is joins
by project and path, and one closure; projects that did not change cost their comparison only.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graphs, state
from ..tables import written
from . import code

KEYS = ["project_id", "path"]
#: The parts of a file's facts that are compared.
FIELDS = ["library", "part_of_uri", "part_of_name", "directives", "parts", "constants", "declarations", "diagnostics"]
SUBSYSTEMS = ["project", "uri_graph", "part_links", "identifier_references", "propagate_dependents"]
#: Rules whose findings depend on a library and what it is linked with; orphan_file depends on the whole graph.
LOCAL_RULES = ["forbidden_import", "layer_boundary", "naming_convention", "unresolved_part"]


def rebuild_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, path, change, changed_fields, *SUBSYSTEMS) of each file that is added, removed or changed.

    A file that comes or goes needs everything. Otherwise directives need the URI graph, what makes up a library its part
    links, and these and declarations the references and the files that depend on this one; other facts only the file's own.
    """
    diff = state.field_diff(old, new, KEYS, FIELDS).where("change <> 'same'")
    whole = F.col("change").isin("added", "removed")
    of: Column = F.col("changed_fields")
    any_of = lambda *fields: F.arrays_overlap(of, F.array(*map(F.lit, fields)))
    members = any_of("library", "part_of_uri", "part_of_name", "parts")
    space = members | any_of("directives")
    needs = {
        "project": F.lit(True),
        "uri_graph": any_of("directives", "parts"),
        "part_links": members,
        "identifier_references": space | any_of("declarations"),
        "propagate_dependents": space | any_of("declarations"),
    }
    return diff.select(*KEYS, "change", F.when(whole, F.array().cast("array<string>")).otherwise(of).alias("changed_fields"), *((whole | c).alias(n) for n, c in needs.items()))


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("resolution = 'resolved'").select("project_id", F.col("source_path").alias("src"), F.col("target_path").alias("dst"))


def changed_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, path) of the files of which an edge came, went or leads elsewhere, whatever the reason."""
    own = lambda df: df.select("project_id", F.col("source_path").alias("path"), "kind", "condition", "uri", "resolution", "target_path")
    both = own(old).withColumn("__side", F.lit(1)).unionByName(own(new).withColumn("__side", F.lit(-1)))
    return both.groupBy(*[c for c in both.columns if c != "__side"]).agg(F.sum("__side").alias("__n")).where("__n <> 0").select(*KEYS).distinct()


def _declared(facts: DataFrame) -> DataFrame:
    return facts.select(*KEYS, F.explode("declarations.name").alias("name"))


def affected_paths(plan: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], references: DataFrame | None = None) -> DataFrame:
    """(project_id, path): changed files, what depends on them before or after, the rest of their libraries, and files that name what they declare.

    plan: of rebuild_plan. old, new: (facts, edges). references: (project_id, path, name), where they are known.
    """
    moved = changed_edges(old[1], new[1])
    starts = plan.where("propagate_dependents").select("project_id", F.col("path").alias("node")).unionByName(moved.select("project_id", F.col("path").alias("node"))).distinct()
    after = graphs.affected(_links(old[1]), _links(new[1]), written(starts, "changed-paths"), ["project_id"]).select("project_id", F.col("node").alias("path"))
    every = plan.select(*KEYS).unionByName(after)
    shifted = plan.where("part_links").select(*KEYS)
    for facts, edges in (old, new):
        pairs = code.part_links(facts, edges).where("part_path is not null").select("project_id", "owner_path", "part_path")
        for a, b in (("owner_path", "part_path"), ("part_path", "owner_path")):
            every = every.unionByName(pairs.withColumnRenamed(a, "path").join(shifted, KEYS).select("project_id", F.col(b).alias("path")))
    if references is not None:
        renamed = plan.where("change <> 'changed' or array_contains(changed_fields, 'declarations')").select(*KEYS)
        names = _declared(old[0]).unionByName(_declared(new[0])).join(renamed, KEYS, "left_semi").select("project_id", "name").distinct()
        every = every.unionByName(references.join(names, ["project_id", "name"], "left_semi").select(*KEYS))
    return every.distinct()


def libraries(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, path, owner): a contested part is a library of its own."""
    return code.owners(facts, code.part_links(facts, edges)).withColumn("owner", F.coalesce("owner", "path"))


def affected_libraries(paths: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, owner) of the affected paths, by what libraries gave before or after."""
    return old.unionByName(new).join(paths, KEYS, "left_semi").select("project_id", "owner").distinct()


def lint_update(kept: DataFrame, affected: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], config: dict[str, Any]) -> DataFrame:
    """The findings of the new state: those of libraries that are not affected are kept, the others computed.

    kept: findings of the old state by the same config. affected: of affected_libraries. The rule on orphan files is
    computed again for the projects whose files or edges changed, in those whole.
    """
    facts, edges = new
    on = set(config.get("enabled_rules", ()))
    member = written(libraries(facts, edges).join(affected, ["project_id", "owner"], "left_semi").select(*KEYS), "lint-members")
    there = facts.select(*KEYS).distinct()
    stay = kept.where("rule_id <> 'orphan_file'").join(there, KEYS, "left_semi").join(member, KEYS, "left_anti")
    out = [stay.select(*kept.columns)]
    own_edges = edges.join(member.withColumnRenamed("path", "source_path"), ["project_id", "source_path"], "left_semi")
    of = lambda rules: {**config, "enabled_rules": sorted(on & set(rules))}
    # A part's file says whom it belongs to, so links need all facts, though edges of the members alone.
    for rules, own in ((["unresolved_part"], facts), ([r for r in LOCAL_RULES if r != "unresolved_part"], facts.join(member, KEYS, "left_semi"))):
        if on & set(rules):
            out.append(code.lint(own, own_edges, of(rules)).select(*kept.columns))
    if "orphan_file" in on:
        came = there.withColumn("__n", F.lit(1)).unionByName(old[0].select(*KEYS).distinct().withColumn("__n", F.lit(-1))).groupBy(*KEYS).agg(F.sum("__n").alias("n")).where("n <> 0")
        moved = written(changed_edges(old[1], edges).unionByName(came.select(*KEYS)).select("project_id").distinct(), "moved-projects")
        out.append(kept.where("rule_id = 'orphan_file'").join(moved, "project_id", "left_anti").select(*kept.columns))
        out.append(code.lint(facts.join(moved, "project_id", "left_semi"), edges.join(moved, "project_id", "left_semi"), of(["orphan_file"])).select(*kept.columns))
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total
