"""Package configurations, ARB files, l10n.yaml and the lint configuration: parsed and validated."""

from __future__ import annotations

import datetime
import json
import re
from urllib.parse import quote, unquote, unquote_to_bytes, urljoin, urlsplit

try:
    import yaml
except ImportError:
    yaml = None

SUPPORTED = 2
_ROOT = "file:///__project__/"
# The characters of package names, and the public forms of versions.
_PACKAGE = re.compile(r"(?=.*[^.])[A-Za-z0-9\-._~!$&'()*+,;=@]+\Z")
_NUMBER = r"(?:0|[1-9]\d*)"
_LANGUAGE = re.compile(rf"{_NUMBER}\.{_NUMBER}\Z")
_IDENT = rf"(?:{_NUMBER}|\d*[A-Za-z-][0-9A-Za-z-]*)"
_SEMVER = re.compile(rf"{_NUMBER}\.{_NUMBER}\.{_NUMBER}(?:-{_IDENT}(?:\.{_IDENT})*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\Z", re.A)
_STAMP = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z\Z", re.A)
_URI = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*\Z")
_BAD_PERCENT = re.compile(r"%(?![0-9A-Fa-f]{2})")


def is_uri(text: str) -> bool:
    return bool(_URI.match(text)) and not _BAD_PERCENT.search(text) and not re.match(r"[^/?#]*[^A-Za-z0-9+.\-/?#][^/?#]*:", text)


def inside_root(uri: str) -> bool:
    """A relative path that never leaves the directory it starts in."""
    if not is_uri(uri) or uri.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", uri) or "?" in uri or "#" in uri:
        return False
    depth = 0
    for part in uri.split("/"):
        raw = unquote_to_bytes(part)
        if b"/" in raw or b"\\" in raw:
            return False
        depth += {b"": 0, b".": 0, b"..": -1}.get(raw, 1)
        if depth < 0:
            return False
    return True


def is_timestamp(text: str) -> bool:
    if not _STAMP.match(text):
        return False
    try:
        datetime.datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ")
    except ValueError:
        return False
    return True


def _directory(uri: str) -> str:
    return uri if uri.endswith("/") else uri + "/"


def _bases(path: str, entry: dict) -> tuple[str, str] | None:
    """The URIs of a package's root and of its library directory."""
    if not is_uri(entry["root_uri"]) or (entry["package_uri"] and not is_uri(entry["package_uri"])):
        return None
    root = _directory(urljoin(_ROOT + quote(path), entry["root_uri"]))
    return root, _directory(urljoin(root, entry["package_uri"])) if entry["package_uri"] else root


def package_config(path: str, source: str) -> dict:
    """config_version, packages and diagnostics (code, severity) of a package configuration."""
    out: dict = {"path": path, "config_version": None, "packages": [], "generated": None, "generator": None, "generator_version": None, "diagnostics": []}
    say = lambda code, severity="error": out["diagnostics"].append({"code": f"package_config_{code}", "severity": severity})
    try:
        raw = json.loads(source)
        version, entries = raw["configVersion"], raw["packages"]
        if isinstance(version, bool) or not isinstance(version, int) or version < 0 or not isinstance(entries, list):
            raise ValueError
        for e in entries:
            if not isinstance(e["name"], str) or not isinstance(e["rootUri"], str) or any(not isinstance(e.get(k) or "", str) for k in ("packageUri", "languageVersion")):
                raise ValueError
    except (ValueError, KeyError, TypeError, RecursionError):
        say("invalid_json")
        return out
    out["config_version"] = version
    for field, key, ok in (("generated", "generated", is_timestamp), ("generator", "generator", lambda _: True), ("generator_version", "generatorVersion", lambda v: bool(_SEMVER.match(v)))):
        value = raw.get(key)
        if value is None:
            continue
        if isinstance(value, str) and ok(value):
            out[field] = value
        else:
            say(f"invalid_{field}", "warning")
    if version != SUPPORTED:
        say("unsupported_version")
    names: set[str] = set()
    for e in entries:
        own = {"name": e["name"], "root_uri": e["rootUri"], "package_uri": e.get("packageUri"), "language_version": e.get("languageVersion")}
        out["packages"].append(own)
        if not _PACKAGE.match(own["name"]):
            say("invalid_name")
        elif own["name"] in names:
            say("duplicate_name")
        names.add(own["name"])
        if not is_uri(own["root_uri"]) or "?" in own["root_uri"] or "#" in own["root_uri"]:
            say("invalid_root_uri")
        if own["package_uri"] is not None and not inside_root(own["package_uri"]):
            say("invalid_package_uri")
        if own["language_version"] is not None and not _LANGUAGE.match(own["language_version"]):
            say("invalid_language_version")
    for code in _overlaps(path, out["packages"]):
        say(code)
    return out


def _overlaps(path: str, packages: list[dict]) -> list[str]:
    """Roots that are equal, and library directories that meet the root of a package within theirs. Sorted roots stand before those within them."""
    found = []
    placed = sorted((unquote(b[0]), unquote(b[1])) for p in packages if (b := _bases(path, p)))
    open_: list[tuple[str, str]] = []
    for root, lib in placed:
        while open_ and not root.startswith(open_[-1][0]):
            open_.pop()
        for outer, outer_lib in open_:
            if outer == root:
                found.append("duplicate_root")
            elif outer_lib.startswith(root) or root.startswith(outer_lib):
                found.append("package_uri_root_overlap")
        open_.append((root, lib))
    return found


def resolve_package_uri(config: dict, uri: str) -> tuple[str, str | None, str | None]:
    """(status, resolved URI, path within the project) of a package: URI under a configuration."""
    if config["config_version"] != SUPPORTED or any(d["severity"] == "error" for d in config["diagnostics"]):
        return "invalid_configuration", None, None
    m = re.match(r"package:([^/]*)/(.*)\Z", uri, re.S)
    if m is None or not _PACKAGE.match(m[1]) or not inside_root(m[2]):
        return "invalid_package_uri", None, None
    entry = next((p for p in config["packages"] if p["name"] == m[1]), None)
    if entry is None:
        return "unknown_package", None, None
    bases = _bases(config["path"], entry)
    if bases is None:
        return "invalid_configured_uri", None, None
    full = urljoin(bases[1], m[2])
    inside = unquote(full.removeprefix(_ROOT)).replace("\\", "/") if full.startswith(_ROOT) and not urlsplit(full).query else None
    return "resolved", full, inside


# What l10n.yaml says where it says nothing.
L10N = {"arb-dir": "lib/l10n", "template-arb-file": "app_en.arb", "output-localization-file": "app_localizations.dart", "output-class": "AppLocalizations", "output-dir": None}


def l10n(source: str) -> tuple[dict, list[str]]:
    """The five keys of l10n.yaml with their defaults, and the codes of what is wrong."""
    if yaml is None:  # an optional package: without it plain lines are read, which is what these files hold
        return {k: dict(re.findall(r"(?m)^([\w-]+):[ \t]*([^\s#]+)", source)).get(k, v) for k, v in L10N.items()}, []
    try:
        got = yaml.safe_load(source) if source.strip() else {}
    except yaml.YAMLError:
        return dict(L10N), ["flutter_l10n_invalid_yaml"]
    got = {} if got is None else got
    if not isinstance(got, dict) or any(k in got and not isinstance(got[k], str) for k in L10N):
        return dict(L10N), ["flutter_l10n_invalid_yaml"]
    return {k: got.get(k, v) for k, v in L10N.items()}, []


def arb(source: str) -> tuple[str | None, list[tuple[str, int, int]], list[str]]:
    """(locale, message keys with their byte ranges, codes) of an ARB file: the top level's keys that do not begin with @."""
    try:
        got = json.loads(source)
    except (ValueError, RecursionError):
        return None, [], ["flutter_arb_invalid_json"]
    if not isinstance(got, dict):
        return None, [], ["flutter_arb_invalid_json"]
    locale = got.get("@@locale")
    out = []
    for key in got:
        if not key.startswith("@"):
            m = re.search(re.escape(json.dumps(key, ensure_ascii=False)) + r"\s*:", source)
            at = len(source[: m.start()].encode("utf-8", "surrogatepass")) if m else 0
            out.append((key, at, at + len(json.dumps(key, ensure_ascii=False).encode("utf-8", "surrogatepass")) if m else 0))
    return locale if isinstance(locale, str) else None, out, []


#: The lint configuration's tables and what their entries are.
_LINT = {"version": int, "enabled_rules": list, "severity_overrides": dict, "forbidden_imports": list, "layer_boundaries": list, "naming": dict, "orphan_files": dict, "failure_threshold": str}
RULES = ("forbidden_import", "layer_boundary", "naming_convention", "orphan_file", "unresolved_part")
SEVERITIES = ("info", "warning", "error")


def lint_config(source: str) -> dict:
    """The configuration of a TOML text; ValueError for unknown fields, wrong kinds, repeats and empty patterns."""
    import tomllib

    got = tomllib.loads(source)
    for key, value in got.items():
        if key not in _LINT:
            raise ValueError(f"unknown field {key}")
        if not isinstance(value, _LINT[key]) or isinstance(value, bool):
            raise ValueError(f"{key} is not a {_LINT[key].__name__}")
    if got.get("version") != 1:
        raise ValueError("version must be 1")
    rules = got.get("enabled_rules", [])
    if len(set(rules)) < len(rules) or not set(rules) | set(got.get("severity_overrides", {})) <= set(RULES):
        raise ValueError("unknown or repeated rule")
    if not set(got.get("severity_overrides", {}).values()) <= set(SEVERITIES):
        raise ValueError("unknown severity")
    for table, fields in (("forbidden_imports", {"pattern", "kind"}), ("layer_boundaries", {"source", "target"})):
        for entry in got.get(table, []):
            if not isinstance(entry, dict) or not set(entry) <= fields or not all(isinstance(v, str) and v for v in entry.values()):
                raise ValueError(f"{table}: wrong or empty entry")
    if got.get("failure_threshold", "error") not in ("never", "warning", "error"):
        raise ValueError("unknown failure_threshold")
    return got
