"""Paths and URIs of source trees, as plain functions and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(path: str) -> str:
    return path.replace("\\", "/")


def parent(path: str) -> str:
    return path.rpartition("/")[0]


def joined(base: str, relative: str) -> str:
    """relative seen from base: '.' goes, '..' takes a name away if there is one, a leading '/' replaces base."""
    out: list[str] = []
    for part in ("" if relative.startswith("/") else base).split("/") + relative.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return ("/" if relative.startswith("/") or base.startswith("/") else "") + "/".join(out)


def has_scheme(uri: str) -> bool:
    """Whether a colon comes before any slash."""
    return ":" in uri.split("/", 1)[0]


def parent_column(path: Column | str) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def joined_column(base: Column, relative: Column) -> Column:
    """joined() in built-in functions: a fold over the names."""
    start = F.when(relative.startswith("/"), F.lit("")).otherwise(base)
    parts = F.filter(F.split(F.concat(start, F.lit("/"), relative), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    root = F.when(relative.startswith("/") | base.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.array_join(folded, "/"))


def uri_class(uri: Column) -> Column:
    scheme = F.split(uri, "/")[0].contains(":")
    return F.when(uri.startswith("dart:"), "dart").when(uri.startswith("package:"), "package").when(scheme, "other").otherwise("relative")


def lower_snake(name: str) -> bool:
    return not name.isascii() or re.fullmatch(r"_*[a-z][a-z0-9]*(_[a-z0-9]+)*", name) is not None


def upper_camel(name: str) -> bool:
    return not name.isascii() or re.fullmatch(r"_*[A-Z][A-Za-z0-9]*", name) is not None


def lower_camel(name: str) -> bool:
    return not name.isascii() or re.fullmatch(r"_*[a-z][A-Za-z0-9]*", name) is not None
