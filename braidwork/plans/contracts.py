"""GraphQL contracts: each use is resolved to its document, and its call and variables are compared."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graphql_text
from ..operators import audits
from . import code

_SPAN = code._SPAN
_SCHEMA = (
    "project_id string, path string, "
    f"operations array<struct<constant_name: string, operation_type: string, operation_name: string, variable_names: array<string>, root_fields: array<string>, span: {_SPAN}>>, "
    f"uses array<struct<prefix: string, constant_name: string, client_call: string, variable_names: array<string>, span: {_SPAN}>>"
)


def extracted(inputs: DataFrame) -> DataFrame:
    """Operations and uses of each Dart file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_SCHEMA))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                rows = [{"project_id": r["project_id"], "path": r["path"], "operations": graphql_text.operations(r["source"] or ""), "uses": graphql_text.uses(r["source"] or "")} for r in batch.slice(lo, 200).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return inputs.where("kind = 'dart'").select(F.col("project_id").cast("string").alias("project_id"), "path", "source").mapInArrow(run, _SCHEMA)


def bindings(facts: DataFrame, edges: DataFrame, graphql: DataFrame) -> DataFrame:
    """A row for each use: bound, with what differs, or the reason why not.

    The constant is resolved like any name; a constant that holds no document is ``missing_operation``.
    """
    uses = graphql.select("project_id", F.col("path").alias("source_path"), F.explode("uses").alias("u")).select("project_id", "source_path", F.col("u.constant_name").alias("name"), "u.prefix", "u.client_call", F.col("u.variable_names").alias("passed"), "u.span")
    asked = uses.select("project_id", "source_path", "name", "prefix").distinct()
    names = code.resolve(facts, edges, asked)
    ops = graphql.select("project_id", "path", F.explode("operations").alias("o")).select("project_id", F.concat("path", F.lit("::variable:"), "o.constant_name").alias("symbol_id"), F.col("path").alias("operation_path"), "o.operation_type", "o.operation_name", F.col("o.variable_names").alias("declared"), "o.root_fields")
    on = (uses["project_id"] == names["project_id"]) & (uses["source_path"] == names["source_path"]) & (uses["name"] == names["name"]) & uses["prefix"].eqNullSafe(names["prefix"])
    found = uses.join(names.withColumnRenamed("status", "resolution"), on).select(uses["*"], "resolution", "symbol_id").join(ops, ["project_id", "symbol_id"], "left")
    status = F.when(F.col("resolution") != "resolved", F.col("resolution")).when(F.col("operation_type").isNull(), "missing_operation").otherwise("bound")
    call = F.when(F.col("operation_type").isNull() | F.col("client_call").isNull(), "unknown").when(F.col("client_call") == F.col("operation_type"), "compatible").otherwise("incompatible")
    bound = F.col("operation_type").isNotNull()
    return found.select(
        "project_id", "source_path", F.col("name").alias("constant_name"), "span", status.alias("status"), "operation_path", "operation_type", "operation_name", "root_fields", call.alias("call"),
        F.when(bound, audits.ordered_difference("declared", "passed")).alias("missing_variables"), F.when(bound, audits.ordered_difference("passed", "declared")).alias("unexpected_variables"),
    )
