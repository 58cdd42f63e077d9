"""Facts of a pubspec: name, dependencies with their sources, environment, declared assets and fonts."""

from __future__ import annotations

import re

try:
    import yaml
except ImportError:  # an optional package: without it every pubspec is reported as not readable
    yaml = None

# The sections of dependencies, in their order.
SECTIONS = ("dependencies", "dev_dependencies", "dependency_overrides")
_NAME = re.compile(r"[a-z_][a-z0-9_]*")


def _line_spans(source: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in source.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass"))
        out.append((at, at + n))
        at += n + 1
    return out


def _flat(node, prefix: str = "") -> dict[str, str] | None:
    """Scalars under a mapping, by dotted name; None if there is a list among them."""
    out: dict[str, str] = {}
    for key, value in node.value:
        name = f"{prefix}.{key.value}" if prefix else key.value
        if isinstance(value, yaml.ScalarNode):
            out[name] = value.value
        elif isinstance(value, yaml.MappingNode):
            inner = _flat(value, name)
            if inner is None:
                return None
            out |= inner
        else:
            return None
    return out


def _source(value) -> tuple[str, dict[str, str]] | None:
    """(kind, fields) of a dependency's source."""
    if isinstance(value, yaml.ScalarNode):
        empty = value.tag == "tag:yaml.org,2002:null"
        return "version", {} if empty else {"constraint": value.value}
    fields = _flat(value) if isinstance(value, yaml.MappingNode) else None
    if fields is None:
        return None
    kinds = ("sdk", "path", "git", "hosted", "workspace")
    return next((k for k in kinds if any(f == k or f.startswith(k + ".") for f in fields)), "version" if set(fields) <= {"version"} else "other"), fields


def facts(path: str, source: str) -> dict:
    """Repeated keys: the last one counts for settings, all of them as dependencies."""
    out: dict = {"path": path, "package_name": None, "dependencies": [], "environment": {}, "assets": [], "fonts": [], "diagnostics": []}
    spans = _line_spans(source)
    span = lambda node: spans[min(node.start_mark.line, len(spans) - 1)]

    def problem(code: str, severity: str, at: tuple[int, int] = (0, 0)) -> None:
        out["diagnostics"].append({"code": code, "severity": severity, "byte_start": at[0], "byte_end": at[1]})

    try:
        root = yaml.compose(source, Loader=yaml.SafeLoader) if yaml else None
    except yaml.composer.ComposerError as e:
        problem("pubspec_multiple_documents_unsupported" if "single document" in str(e) else "pubspec_unsupported_yaml_alias", "error")
        return out
    except yaml.YAMLError:
        problem("pubspec_invalid_yaml", "error")
        return out
    if not isinstance(root, yaml.MappingNode if yaml else ()):
        problem("pubspec_missing_name" if root is None and yaml else "pubspec_invalid_yaml", "error")
        return out
    seen: set[str] = set()
    top = {}
    for key, value in root.value:
        if key.value in seen:
            problem("pubspec_duplicate_key", "error", span(key))
        seen.add(key.value)
        top[key.value] = value
        if key.value in SECTIONS and isinstance(value, yaml.MappingNode):
            for name, spec in value.value:
                got = _source(spec)
                if got is None:
                    problem("pubspec_invalid_yaml", "error", span(name))
                else:
                    a, b = span(name)
                    out["dependencies"].append({"section": key.value, "name": name.value, "kind": got[0], "fields": got[1], "byte_start": a, "byte_end": b})
    name = top.get("name")
    if not isinstance(name, yaml.ScalarNode) or not name.value:
        problem("pubspec_missing_name", "error")
    else:
        out["package_name"] = name.value
        if not _NAME.fullmatch(name.value):
            problem("pubspec_invalid_name", "error", span(name))
    env = top.get("environment")
    if isinstance(env, yaml.MappingNode):
        out["environment"] = _flat(env) or {}
    elif env is not None:
        problem("pubspec_invalid_environment", "error", span(env))
    flutter = top.get("flutter")
    if isinstance(flutter, yaml.MappingNode):
        settings = {k.value: v for k, v in flutter.value}
        assets = settings.get("assets")
        for item in assets.value if isinstance(assets, yaml.SequenceNode) else ():
            entry = {k.value: v for k, v in item.value} if isinstance(item, yaml.MappingNode) else {"path": item}
            where = entry.get("path")
            if not isinstance(where, yaml.ScalarNode) or not where.value:
                problem("pubspec_invalid_flutter_asset", "error", span(item))
                continue
            flavors = entry.get("flavors")
            a, b = span(item)
            out["assets"].append({"asset": where.value, "flavors": [f.value for f in flavors.value] if isinstance(flavors, yaml.SequenceNode) else [], "byte_start": a, "byte_end": b})
        fonts = settings.get("fonts")
        for family in fonts.value if isinstance(fonts, yaml.SequenceNode) else ():
            entry = {k.value: v for k, v in family.value} if isinstance(family, yaml.MappingNode) else {}
            files = entry.get("fonts")
            for f in files.value if isinstance(files, yaml.SequenceNode) else ():
                own = _flat(f) if isinstance(f, yaml.MappingNode) else None
                if not own or "asset" not in own or not isinstance(entry.get("family"), yaml.ScalarNode):
                    problem("pubspec_invalid_flutter_font", "error", span(f))
                    continue
                weight = own.get("weight")
                if weight is not None and weight not in {str(w) for w in range(100, 1000, 100)}:
                    problem("pubspec_invalid_flutter_font_weight", "error", span(f))
                    weight = None
                out["fonts"].append({"family": entry["family"].value, "asset": own["asset"], "weight": int(weight) if weight else None})
    elif flutter is not None and flutter.value:
        problem("pubspec_invalid_flutter_configuration", "error", span(flutter))
    return out
