"""The command line: ``python -m braidwork.cli COMMAND PATH [--env key=value]... [--config FILE] [--format json|sarif] [--deny-warnings]``.

Commands: analyze-file, pubspec, pubspec-config, analyze-project, graphql-contracts, uri-graph, flutter-inventory, lint. Each writes one
versioned JSON document. A project's result is bounded by its input budgets and is brought to this process to be written.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import calls_text, config_text, pubspec_text, source_text
from .plans import code, contracts, conventions
from .session import session, ship
from .sources import projects

# What a command's exit status means, and the contracts of the documents.
OK, INTERNAL, USAGE, INPUT, FINDINGS, CONFIGURATION, PROJECT = range(7)
CONTRACTS = {
    "analyze-file": "file-analysis", "pubspec": "pubspec-analysis", "pubspec-config": "pubspec-configuration", "analyze-project": "project-analysis",
    "graphql-contracts": "graphql-contracts", "uri-graph": "uri-graph", "flutter-inventory": "flutter-inventory", "lint": "lint-analysis",
}
VERSION = 1


class Failure(Exception):
    def __init__(self, status: int, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.status = status


def envelope(contract: str, data: Any, pretty: bool = False) -> str:
    """The versioned document of a contract's data."""
    if contract not in CONTRACTS.values():
        raise ValueError(f"no contract {contract}")
    return json.dumps({"schema": f"braidwork.{contract}", "version": VERSION, "data": data}, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def fails(severities: list[str], threshold: str, deny_warnings: bool = False) -> bool:
    """Whether findings of these severities are failures: never, from warnings on, or from errors on."""
    least = {"never": 3, "warning": 1, "error": 2}["warning" if deny_warnings else threshold]
    return any({"info": 0, "warning": 1, "error": 2}[s] >= least for s in severities)


def _rows(df: DataFrame, order: list[str]) -> list[dict]:
    columns = [c for c in df.columns if c != "project_id"]
    return [json.loads(r["j"]) for r in df.orderBy(*order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j")).collect()]


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            source = f.read(projects.FILE_BYTES + 1)
    except (OSError, UnicodeDecodeError) as e:
        raise Failure(INPUT, "input_unreadable", str(e)) from e
    if len(source.encode()) > projects.FILE_BYTES:
        raise Failure(INPUT, "input_limit_exceeded", path)
    return source


#: Edges in the order of file, place, kind and URI; kinds in the order of the language.
KINDS = ["import", "export", "part"]


def ordered_edges(edges: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return edges.withColumn("rank", rank).orderBy("source_path", "span.byte_start", "rank", "uri").drop("rank")


def _project(args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, list[dict]]:
    spark = ship(session())
    try:
        projects.reject_symlinks(args.path)
    except ValueError as e:
        raise Failure(INPUT, "input_symlink_rejected", str(e).partition(": ")[2]) from e
    try:
        inputs, twice = projects.unique_inputs(projects.within_budget(projects.read_tree(spark, args.path)))
    except ValueError as e:
        raise Failure(INPUT, "input_limit_exceeded", str(e)) from e
    inputs = code.written(inputs, "inputs")
    if inputs.isEmpty():
        raise Failure(INPUT, "input_empty", args.path)
    facts = code.written(code.extracted(inputs), "facts")
    env = dict(kv.split("=", 1) for kv in args.env) if args.env else None
    return inputs, facts, code.written(code.uri_edges(facts, inputs, env), "uri-edges"), _rows(twice, ["path"])


def _analyze_file(args: argparse.Namespace) -> tuple[Any, int]:
    source = _read(args.path)
    return source_text.facts(args.path, source) | calls_text.facts(args.path, source), OK


def _pubspec(args: argparse.Namespace) -> tuple[Any, int]:
    got = pubspec_text.facts(args.path, _read(args.path))
    return {k: got[k] for k in ("path", "package_name", "dependencies", "diagnostics")}, OK


def _pubspec_config(args: argparse.Namespace) -> tuple[Any, int]:
    got = pubspec_text.facts(args.path, _read(args.path))
    return {k: got[k] for k in ("path", "environment", "assets", "fonts", "diagnostics")}, OK


def _analyze_project(args: argparse.Namespace) -> tuple[Any, int]:
    inputs, facts, edges, twice = _project(args)
    found = facts.select("project_id", "path", F.explode("diagnostics").alias("d")).select("project_id", "path", "d.*")
    return {"summary": _rows(code.summary(facts, edges), ["n_files"]), "files": _rows(facts, ["path"]), "diagnostics": twice + _rows(found, ["path", "span.byte_start", "code"])}, PROJECT if any(d["severity"] == "error" for d in twice) else OK


def _graphql(args: argparse.Namespace) -> tuple[Any, int]:
    inputs, facts, edges, _ = _project(args)
    return _rows(contracts.bindings(facts, edges, code.written(contracts.extracted(inputs), "graphql")), ["source_path", "span.byte_start"]), OK


def _uri_graph(args: argparse.Namespace) -> tuple[Any, int]:
    _, _, edges, _ = _project(args)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return _rows(edges, ["source_path", "span.byte_start", rank, "uri"]), OK


def _flutter(args: argparse.Namespace) -> tuple[Any, int]:
    inputs, facts, _, _ = _project(args)
    calls = code.written(conventions.code_facts(inputs), "code-facts")
    parts = {"routes": conventions.routes(calls, facts), "assets": conventions.asset_uses(calls), "localizations": conventions.localization_uses(calls), "themes": conventions.themes(calls, facts)}
    return {"summary": _rows(conventions.inventory(calls, facts), ["flutter_widgets"])} | {k: _rows(df, ["path", "byte_start"]) for k, df in parts.items()}, OK


def _lint(args: argparse.Namespace) -> tuple[Any, int]:
    try:
        config = config_text.lint_config(_read(args.config)) if args.config else {}
    except ValueError as e:
        raise Failure(CONFIGURATION, "lint_configuration_invalid", str(e)) from e
    _, facts, edges, _ = _project(args)
    found = code.lint(facts, edges, config)
    order = ["path", "span.byte_start", "rule_id", "message"]
    findings = _rows(found, order)
    status = FINDINGS if fails([f["severity"] for f in findings], config.get("failure_threshold", "error"), args.deny_warnings) else OK
    if args.format == "sarif":
        rules = list(config.get("enabled_rules", ()))
        results = [r["json"] for r in code.sarif_results(found, rules).orderBy("path", "byte_start", "json").collect()]
        print(code.sarif(results, rules))
        return None, status
    counts = {s: sum(f["severity"] == s for f in findings) for s in config_text.SEVERITIES}
    return {"summary": counts, "diagnostics": findings}, status


COMMANDS: dict[str, Callable[[argparse.Namespace], tuple[Any, int]]] = dict(zip(CONTRACTS, (_analyze_file, _pubspec, _pubspec_config, _analyze_project, _graphql, _uri_graph, _flutter, _lint), strict=True))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="braidwork", exit_on_error=False)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("path")
    parser.add_argument("--env", action="append", default=[])
    parser.add_argument("--config")
    parser.add_argument("--format", choices=["json", "sarif"], default="json")
    parser.add_argument("--deny-warnings", action="store_true")
    parser.add_argument("--pretty", action="store_true")
    try:
        args = parser.parse_args(argv)
        if any("=" not in kv for kv in args.env):
            raise argparse.ArgumentError(None, "--env takes key=value")
    except (argparse.ArgumentError, SystemExit) as e:
        print(e, file=sys.stderr)
        return USAGE
    try:
        data, status = COMMANDS[args.command](args)
    except Failure as e:
        print(e, file=sys.stderr)
        return e.status
    if data is not None:
        print(envelope(CONTRACTS[args.command], data, args.pretty))
    return status


if __name__ == "__main__":
    sys.exit(main())
