"""GraphQL documents in string constants, and where clients use them."""

from __future__ import annotations

import re

from .source_text import Lines, mask

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_DOCUMENT = re.compile(rf"^(?:const|final)\s+(?:String\s+)?({_NAME})\s*=\s*r?('''|\"\"\")(.*?)\2", re.S | re.M)
_HEAD = re.compile(rf"\s*(query|mutation|subscription)\b\s*({_NAME})?\s*(?:\(([^)]*)\))?")
_TOKEN = re.compile(rf"#[^\n]*|[{{}}()]|{_NAME}|.", re.S)
_USE = re.compile(rf"\bgql\s*\(\s*(?:({_NAME})\s*\.\s*)?({_NAME})\s*\)")
_CALL = re.compile(r"\.\s*(query|mutate|subscribe)\s*(?:<[^>]*>)?\s*\(")
_KEY = re.compile(r"(['\"])(\w+)\1\s*:")
# The operation that each client call runs; words that are no fields; how far a use's variables may stand.
_RUNS = {"query": "query", "mutate": "mutation", "subscribe": "subscription"}
_NO_FIELDS = {"fragment", "on"}
_LOOK_AHEAD = 80


def root_fields(document: str) -> list[str]:
    """Names at the first level of a selection, outside of arguments, sorted."""
    depth, inside, found = 0, 0, set()
    for t in _TOKEN.findall(document[document.find("{") :] if "{" in document else ""):
        if t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
            if depth <= 0:
                break
        elif t in "()" and depth == 1:
            inside = max(0, inside + (1 if t == "(" else -1))
        elif depth == 1 and not inside and re.fullmatch(_NAME, t) and t not in _NO_FIELDS:
            found.add(t)
    return sorted(found)


def operations(source: str) -> list[dict]:
    """The documents of a text's constants: type, name, variables, root fields and the span of lines."""
    lines, out = Lines(source.encode("utf-8", "surrogatepass")), []
    at = lambda k: len(source[:k].encode("utf-8", "surrogatepass"))
    for m in _DOCUMENT.finditer(source):
        head = _HEAD.match(m[3])
        if head:
            names = sorted(set(re.findall(r"\$(\w+)", head[3] or "")))
            out.append({"constant_name": m[1], "operation_type": head[1], "operation_name": head[2], "variable_names": names, "root_fields": root_fields(m[3]), "span": lines.span(at(m.start()), at(m.end()))})
    return out


def _lines_on(text: str, at: int, n: int) -> int:
    """Where the n-th line after a place begins, or the end."""
    for _ in range(n):
        at = text.find("\n", at) + 1
        if not at:
            return len(text)
    return at


def uses(source: str) -> list[dict]:
    """Uses gql(CONSTANT): the constant and its prefix, what the client runs, and the variables it passes."""
    raw = source.encode("utf-8", "surrogatepass")
    code, lines, out = mask(raw)[0].decode("utf-8", "replace"), Lines(raw), []
    if len(code) != len(source):  # offsets of characters are wanted: blank what is not ASCII alike in both
        source = raw.decode("latin-1")
        code = mask(raw)[0].decode("latin-1")
    for m in _USE.finditer(code):
        statement = code.rfind(";", 0, m.start()) + 1
        calls = _CALL.findall(code, statement, m.start())
        end = code.find(";", m.end())
        end = min(len(code) if end < 0 else end, _lines_on(code, m.end(), _LOOK_AHEAD))
        names: list[str] = []
        opening = re.search(r"\bvariables\s*:\s*(?:const\s*)?(?:<[^>{]*>\s*)?\{", code[m.end() : end])
        if opening:
            k, depth = m.end() + opening.end(), 1
            while k < end and depth:
                if depth == 1 and code[k] == " " and (key := _KEY.match(source, k)):
                    names.append(key[2])
                    k = key.end()
                    continue
                depth += (code[k] in "{([") - (code[k] in "})]")
                k += 1
        byte = lambda k: k if len(code) == len(raw) else len(code[:k].encode())
        out.append({"prefix": m[1], "constant_name": m[2], "client_call": _RUNS[calls[-1]] if calls else None, "variable_names": sorted(set(names)), "span": lines.span(byte(m.start()), byte(m.end()))})
    return out
