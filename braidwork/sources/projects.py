"""Source trees as tables: one row for each file, without what is generated or vendored."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits

# Directories whose contents are not sources.
SKIPPED = [".dart_tool", ".git", ".idea", ".pub-cache", ".vscode", "build", "coverage", "node_modules", "Pods", "target"]
# The budgets of one project, in bytes and files.
FILE_BYTES, PROJECT_FILES, PROJECT_BYTES = 8 << 20, 20_000, 256 << 20


def reject_symlinks(root: str) -> None:
    """Fails on a link below a local root that leads out of it, to a directory, or to nothing; links to files within it are read.

    Other stores have no links. Directories that are skipped are not looked into, but for a package's config.
    """
    base = Path(root)
    if not base.is_dir():
        return
    inside = base.resolve()

    def check(link: Path) -> None:
        at = link.resolve()
        if not at.is_relative_to(inside):
            why = "leads out of the project"
        elif at.is_dir():
            why = "leads to a directory"
        elif not at.is_file():
            why = "leads to no regular file"
        else:
            return
        raise ValueError(f"input_symlink_rejected: {link} {why}")

    for here, below, files in os.walk(base):
        for name in (*below, *files):
            if (link := Path(here, name)).is_symlink():
                check(link)
        below[:] = [d for d in below if d not in SKIPPED]
        config = Path(here, ".dart_tool", "package_config.json")
        if "pubspec.yaml" in files and config.is_symlink():
            check(config)


def read_tree(spark: SparkSession, root: str, project_id: str = "project") -> DataFrame:
    """(project_id, kind, path, source, n_bytes) of a tree's Dart files, pubspecs, package configs and catalogs.

    Spark lists and reads the files, so any store that it knows will do; paths are relative to root.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    path = F.substring(full, F.length(base) + 1, F.length(full))
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    kind = (
        F.when(name.endswith(".dart"), "dart")
        .when(name == "pubspec.yaml", "pubspec")
        .when(F.col("path").endswith(".dart_tool/package_config.json"), "package_config")
        .when(name == "l10n.yaml", "l10n")
        .when(name.endswith(".arb"), "arb")
    )
    kept = ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIPPED)))
    rows = files.select(path.alias("path"), "content", F.col("length").alias("n_bytes")).withColumn("kind", kind)
    rows = rows.where(F.col("kind").isNotNull() & (kept | (F.col("kind") == "package_config")))
    return rows.select(F.lit(project_id).alias("project_id"), "kind", "path", F.decode("content", "UTF-8").alias("source"), "n_bytes")


def within_budget(inputs: DataFrame) -> DataFrame:
    """inputs unchanged; the job fails if a file or a project is beyond its budget. Where sizes are listed, no content is read for it."""
    sized = inputs.withColumn("__n", F.col("n_bytes") if "n_bytes" in inputs.columns else F.octet_length("source"))
    over = F.sum("__n") > PROJECT_BYTES
    found = sized.groupBy("project_id").agg((over | (F.count("*") > PROJECT_FILES) | (F.max("__n") > FILE_BYTES)).alias("over")).where("over").select("project_id")
    bad = [r["project_id"] for r in found.limit(5).collect()]  # a report of a few
    if bad:
        raise ValueError(f"input_limit_exceeded: {', '.join(map(str, bad))}")
    return inputs


def unique_inputs(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs with one source for each path, and diagnostics of the paths that came more than once."""
    rows = inputs.withColumn("path", F.translate("path", "\\", "/")).withColumn("__digest", F.sha2("source", 256))
    keys = ["project_id", "kind", "path"]
    status = audits.resolve_duplicates(rows, keys, "__digest", "__digest")
    good = rows.join(status.where("status <> 'conflicting'").select(*keys), keys, "left_semi").dropDuplicates(keys).drop("__digest")
    twice = status.where("n_rows > 1")
    severity = F.when(F.col("status") == "conflicting", "error").otherwise("warning")
    return good, twice.select("project_id", "path", F.lit("duplicate_project_input_path").alias("code"), severity.alias("severity"))
