"""Pubspec tables, widgets, and assets declared against assets used."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pubspec_text, source_text
from ..operators import prefixes

_PUBSPEC = (
    "project_id string, path string, package_name string, dependencies array<struct<section: string, name: string, kind: string, fields: map<string, string>, byte_start: long, byte_end: long>>, environment map<string, string>, "
    "assets array<struct<asset: string, flavors: array<string>, byte_start: long, byte_end: long>>, fonts array<struct<family: string, asset: string, weight: int>>, diagnostics array<struct<code: string, severity: string, byte_start: long, byte_end: long>>"
)
# What widgets extend, and calls whose first literal argument names an asset.
WIDGET_BASES = ["Widget", "StatelessWidget", "StatefulWidget", "InheritedWidget", "State", "ConsumerWidget"]
ASSET_CALLS = {"Image.asset": "image_asset", "AssetImage": "asset_image", "rootBundle.loadString": "root_bundle_load_string"}
_CALL = re.compile(r"(?<![\w.$])(" + "|".join(map(re.escape, ASSET_CALLS)) + r")\s*\(")
_LITERAL = re.compile(r"""\s*(?:'([^'\\$]*)'|"([^"\\$]*)")\s*[,)]""")


def _mapped(inputs: DataFrame, kind: str, schema: str, one) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                rows = [x | {"project_id": r["project_id"]} for r in batch.slice(lo, 200).to_pylist() for x in one(r["path"], r["source"] or "")]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return inputs.where(F.col("kind") == kind).select(F.col("project_id").cast("string").alias("project_id"), "path", "source").mapInArrow(run, schema)


def pubspecs(inputs: DataFrame) -> DataFrame:
    """A row for each pubspec, with its lists nested."""

    def one(path: str, source: str) -> list[dict]:
        got = pubspec_text.facts(path, source)
        return [got | {"environment": list(got["environment"].items()), "dependencies": [d | {"fields": list(d["fields"].items())} for d in got["dependencies"]]}]

    return _mapped(inputs, "pubspec", _PUBSPEC, one)


def dependencies(specs: DataFrame) -> DataFrame:
    """(project_id, path, section, name, kind, fields) of all pubspecs, repeated ones too."""
    return specs.select("project_id", "path", F.explode("dependencies").alias("d")).select("project_id", "path", "d.section", "d.name", "d.kind", "d.fields")


def widgets(facts: DataFrame) -> DataFrame:
    """Classes that extend a widget, by the last name of what they extend."""
    d = facts.select("project_id", "path", F.explode("declarations").alias("d")).where("d.kind = 'class'")
    return d.where(F.substring_index("d.extends", ".", -1).isin(WIDGET_BASES)).select("project_id", "path", "d.name", "d.extends", "d.span")


def asset_uses(inputs: DataFrame) -> DataFrame:
    """(project_id, path, source, asset, byte_start) of the calls that name an asset by a plain literal."""

    def one(path: str, text: str) -> list[dict]:
        raw = text.encode("utf-8", "surrogatepass")
        code, plain = source_text.mask(raw)[0].decode("latin-1"), raw.decode("latin-1")
        out = []
        for m in _CALL.finditer(code):
            if arg := _LITERAL.match(plain, m.end()):
                asset = (arg[1] if arg[1] is not None else arg[2]).encode("latin-1").decode("utf-8", "replace")
                out.append({"path": path, "source": ASSET_CALLS[m[1]], "asset": asset, "byte_start": m.start()})
        return out

    return _mapped(inputs, "dart", "project_id string, path string, source string, asset string, byte_start long", one)


def linked_assets(specs: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations of the nearest pubspec with their use counts; uses with the declaration that they match.

    A file matches itself and goes before a directory, which matches its direct children: two equi-joins.
    """
    roots = specs.select("project_id", F.regexp_replace("path", "/?[^/]*$", "").alias("root"), F.col("path").alias("pubspec_path"))
    declared = specs.select("project_id", F.col("path").alias("pubspec_path"), F.explode("assets").alias("a")).select("project_id", "pubspec_path", F.col("a.asset").alias("declared"), F.when(F.col("a.asset").endswith("/"), "directory").otherwise("file").alias("kind"))
    clean = F.regexp_replace(F.translate("asset", "\\", "/"), r"^(\./)+", "")
    near = prefixes.nearest(uses.withColumn("use", F.monotonically_increasing_id()), roots, "path", "root", ["project_id"]).withColumn("file", clean)
    near = near.withColumn("wanted", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("file").alias("declared")), F.struct(F.lit(1).alias("rank"), F.regexp_replace("file", "[^/]*$", "").alias("declared")))))
    hit = near.join(declared, (near["project_id"] == declared["project_id"]) & (near["pubspec_path"] == declared["pubspec_path"]) & (near["wanted.declared"] == declared["declared"]) & ((near["wanted.rank"] == 0) == (declared["kind"] == "file")))
    best = hit.groupBy("use").agg(F.min_by(F.struct(declared["declared"], declared["kind"]), near["wanted.rank"]).alias("d"))
    each = near.where("wanted.rank = 0").join(best, "use", "left").select("project_id", "path", "source", "asset", "pubspec_path", F.col("d.declared").alias("declared"), F.when(F.col("d").isNull(), "flutter_asset_used_but_undeclared").alias("code"))
    counts = each.where("declared is not null").groupBy("project_id", "pubspec_path", "declared").agg(F.count("*").alias("use_count"))
    total = declared.join(counts, ["project_id", "pubspec_path", "declared"], "left").withColumn("use_count", F.coalesce("use_count", F.lit(0)))
    return total.withColumn("code", F.when(F.col("use_count") == 0, "flutter_asset_declared_but_unused")), each
