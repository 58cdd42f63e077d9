"""Invocations of a source text with their arguments, and the names that types and calls refer to."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

from . import source_text
from .code_tokens import Tokens, is_name
from .members_text import CALLABLES, Inventory

# Words before a parenthesis that are no call.
RESERVED = {"assert", "catch", "class", "do", "else", "enum", "extension", "for", "if", "mixin", "return", "switch", "typedef", "while", "with"}
#: What follows the first name of a chain that holds a call.
_GOES_ON = frozenset(("(", "<", ".", "?.", "!"))
_CLAUSES = frozenset(("extends", "with", "implements", "on"))
_TELLS = _CLAUSES | {"new", "const"}
_OPENS = frozenset("([")
_DOTS = frozenset((".", "?."))
_LITERAL = re.compile(r"(r?)('''|\"\"\"|'|\")(.*)\2\Z", re.S)
_TRIVIA = re.compile(r"(?:\s+|//[^\r\n]*|/\*.*?\*/)*", re.S)


def string_value(expression: str) -> str | None:
    """The text of an expression that is one string literal; only escaped quotes are unescaped."""
    m = _LITERAL.match(expression.strip())
    if m is None:
        return None
    return m[3] if m[1] else m[3].replace("\\'", "'").replace('\\"', '"')


class Calls:
    def __init__(self, source: bytes, t: Tokens, lines: source_text.Lines) -> None:
        self.source, self.t, self.lines = source, t, lines

    def _text(self, start: int, end: int) -> str:
        return self.source[start:end].decode("utf-8", "replace")

    def _trimmed(self, lo_byte: int, hi_byte: int) -> tuple[int, int]:
        raw = self.source[lo_byte:hi_byte]
        return lo_byte + len(raw) - len(raw.lstrip()), hi_byte - (len(raw) - len(raw.rstrip()))

    def _pieces(self, open_: int, mark: str) -> list[tuple[int, int, int, int]]:
        """Between a bracket and its partner: (first token, behind the last, first byte, behind the last) of each part that holds anything."""
        t, close = self.t, self.t.partner[open_]
        out = []
        for a, b in t.split(open_ + 1, close, mark):
            lo = t.ends[a - 1]
            hi = t.starts[b]
            lo, hi = self._trimmed(lo, hi)
            if lo < hi:
                out.append((a, b, lo, hi))
        return out

    def arguments(self, open_: int) -> list[dict]:
        out = []
        for a, b, lo, hi in self._pieces(open_, ","):
            name, begin, first = None, lo, a
            if a + 1 < b and is_name(self.t.texts[a]) and self.t.texts[a + 1] == ":" and self.t.starts[a] == lo:
                name, first = self.t.texts[a], a + 2
                begin, _ = self._trimmed(self.t.ends[a + 1], hi)
            if begin >= hi:
                continue
            expression = self._text(begin, hi)
            out.append({"name": name, "expression": expression, "string_value": string_value(expression), "map_entries": self._entries(first, b, hi), "byte_start": lo, "byte_end": hi})
        return out

    def _entries(self, a: int, b: int, hi: int) -> list[dict]:
        """Keys and values of the first braces of tokens a to b."""
        t, k = self.t, a
        while k < b and t.texts[k] != "{":
            k = t.partner[k] if t.texts[k] in _OPENS and t.partner[k] >= 0 else k
            k += 1
        if k >= b or t.partner[k] < 0 or t.starts[t.partner[k]] >= hi:
            return []
        out = []
        for x, y, lo, end in self._pieces(k, ","):
            colon = t.split(x, y, ":")[0][1]
            if colon >= y:
                continue
            lo += len(_TRIVIA.match(self._text(lo, t.starts[colon]))[0].encode())
            key, value = self._text(lo, t.starts[colon]).strip(), self._text(t.ends[colon], end).strip()
            if key and value:
                out.append({"key": key, "string_key": string_value(key), "value": value, "byte_start": lo, "byte_end": end})
        return out

    def chains(self) -> list[dict]:
        """Every call of every dotted chain: target, parenthesis and the members read from its result."""
        t, out = self.t, []
        texts, partner, n = t.texts, t.partner, len(t.texts)
        for k, after in enumerate(texts[1:]):
            if after not in _GOES_ON:
                continue
            text = texts[k]
            if text in RESERVED or not is_name(text):
                continue
            if k and texts[k - 1] in (".", "?.", "$") and t.ends[k - 1] == t.starts[k]:
                continue
            parts, j, calls = [text], k + 1, []
            while True:
                at = t.angles_end(j) if j < n and texts[j] == "<" else j
                if at < n and texts[at] == "(" and partner[at] >= 0:
                    calls.append({"target": ".".join(parts), "first": k, "open": at, "end": t.ends[partner[at]], "members": []})
                    j = partner[at] + 1
                    continue
                while j < n and texts[j] == "!":
                    j += 1
                if j + 1 >= n or texts[j] not in _DOTS or not is_name(texts[j + 1]):
                    break
                parts.append(texts[j + 1])
                j += 2
                if calls and t.at(t.angles_end(j)) != "(":
                    calls[-1]["members"].append(parts[-1])
                    calls[-1]["end"] = t.ends[j - 1]
            out += calls
        return out


#: What facts gives, beside the path; ``names`` is given only where it is asked for.
FIELDS = ("members", "bindings", "invocations", "references", "problems")


def facts(path: str, source: str) -> dict:
    """Everything that calls, members and names of a file say, beside what source_text.facts says."""
    return wanted(path, source, FIELDS)


def wanted(path: str, source: str, only: Collection[str], lines: bool = True) -> dict:
    """The fields that are wanted, of these facts and source_text's, in one pass; spans without lines are byte ranges alone.

    Calls get their arguments and the callable around them if ``invocations`` or ``invocations.arguments`` is among the fields;
    ``names`` get their places by ``names`` or ``names.places``.
    """
    raw = source.encode("utf-8", "surrogatepass")
    masked, never_end = source_text.mask(raw)
    spans = source_text.Lines(raw) if lines else source_text.Bytes(raw)
    out = source_text.read(path, masked, never_end, spans, "constants" in only) if any(f not in FIELDS for f in only if "." not in f) else {}
    return out | read(path, raw, masked, spans, only, out.get("declarations"))


def read(path: str, raw: bytes, masked: bytes, lines: source_text.Lines, only: Collection[str] = FIELDS, declared: list[dict] | None = None) -> dict:
    """facts of a text that is masked already; declared: source_text.declarations of it, if they are known."""
    have = Inventory(path, masked, lines, declared)
    out = {"path": path}
    if "members" in only:
        out["members"] = have.rows
    if "bindings" in only:
        out["bindings"] = have.bindings
    if "problems" in only:
        out["problems"] = [{"code": c, "severity": "warning", "span": lines.span(a, b)} for c, a, b in have.problems]
    if "names" in only:
        out["names"] = _names(have, _invocations(have, raw, lines, None, False), "names.places" in only or not any(f.startswith("names.") for f in only))
    if "invocations" in only or "references" in only:
        bodies = [(d["declaration_span"]["byte_start"], d["declaration_span"]["byte_end"], d["symbol_id"]) for d in have.rows if d["kind"] in CALLABLES]

        def enclosing(at: int) -> str | None:
            inside = [(end - start, symbol) for start, end, symbol in bodies if start <= at < end]
            return min(inside)[1] if inside else None

        found = _invocations(have, raw, lines, enclosing, "invocations" in only and ("invocations.arguments" in only or not any(f.startswith("invocations.") for f in only)))
        if "invocations" in only:
            out["invocations"] = found
        if "references" in only:
            out["references"] = _references(have, found, enclosing, lines)
    return out


def _invocations(have: Inventory, raw: bytes, lines: source_text.Lines, enclosing, whole: bool) -> list[dict]:
    """The calls that are no declaration's header; whole: with their arguments and the callable around them."""
    calls = Calls(raw, have.t, lines)
    headers = {(d["name"], have.t.first_from(d["declaration_span"]["byte_start"])): d for d in have.rows}
    headed: dict[str, list[tuple[int, dict]]] = {}
    for (name, first), d in headers.items():
        headed.setdefault(name, []).append((first, d["declaration_span"]))

    def is_header(call: dict) -> bool:
        at = have.t.starts[call["first"]]
        for first, span in headed.get(call["target"], ()):
            if span["byte_start"] <= at < span["byte_end"]:
                edge = next((have.t.starts[j] for j in range(first, len(have.t)) if have.t.texts[j] in ("{", "=>", ";", "=")), span["byte_end"])
                if at < edge:
                    return True
        return False

    found, seen = [], set()
    for c in calls.chains():
        start = have.t.starts[c["first"]]
        key = (start, c["end"], c["target"])
        if key not in seen and not is_header(c):
            seen.add(key)
            call = {"target": c["target"], "result_members": c["members"], "span": lines.span(start, c["end"])}
            if whole:
                call |= {"arguments": calls.arguments(c["open"]), "enclosing_symbol_id": enclosing(start)}
            found.append(call)
    found.sort(key=lambda x: (x["span"]["byte_start"], x["span"]["byte_end"], x["target"]))
    return found


class Bound:
    """The bindings of a file by name."""

    def __init__(self, bindings: list[dict]) -> None:
        self.named: dict[str, list[dict]] = {}
        for b in bindings:
            self.named.setdefault(b["name"], []).append(b)

    def at(self, name: str, at: int) -> bool:
        return name in self.named and any(b["scope_start"] <= at < b["scope_end"] for b in self.named[name])


def _namespace(have: Inventory, invocations: list[dict], bound: Bound) -> Iterator[tuple[str, str | None, str, str, int]]:
    """(name, prefix, kind, confidence, token) of calls, type clauses and constructors."""
    t, own = have.t, {}
    for d in have.rows:
        if d["kind"] in ("method", "field", "getter", "setter") and not d["is_static"]:
            own.setdefault(d["name"], []).append(d["parent_symbol_id"])
    types = {d["symbol_id"]: d["declaration_span"] for d in have.rows if d["parent_symbol_id"] is None}
    for c in invocations:
        parts = c["target"].split(".")
        at = c["span"]["byte_start"]
        hidden = bound.at(parts[0], at) or any(types[p]["byte_start"] <= at < types[p]["byte_end"] for p in own.get(parts[0], ()) if p in types)
        if len(parts) > 2 or parts[0] in ("this", "super") or hidden:
            continue
        k = t.first_from(at)
        if len(parts) == 2:
            yield parts[1], parts[0], "invocation_target", "high", k + 2
        else:
            yield parts[0], None, "invocation_target", "medium", k
    for k, text in enumerate(t.texts):
        if text not in _TELLS:
            continue
        if text in _CLAUSES and is_name(t.at(k + 1)) and t.at(k - 1) not in (".", "?."):
            j = k + 1
            while is_name(t.at(j)):
                dotted = t.at(j + 1) == "." and is_name(t.at(j + 2))
                yield t.texts[j + 2] if dotted else t.texts[j], t.texts[j] if dotted else None, "type_annotation", "high", j + 2 if dotted else j
                j = t.angles_end(j + 3 if dotted else j + 1)
                if t.at(j) != ",":
                    break
                j += 1
        elif text in ("new", "const") and is_name(t.at(k + 1)) and t.at(k + 1)[:1].isupper():
            j = k + 1
            if t.at(t.angles_end(j + 1)) in ("(", "."):
                yield t.texts[j], None, "constructor_target", "high", j


def _names(have: Inventory, invocations: list[dict], whole: bool) -> list[dict]:
    """Each name and prefix that a file's calls, type clauses and constructors hold, once: how often, and the ids of the file's own declarations of it; whole: with its places."""
    t, found = have.t, {}
    for name, prefix, kind, _, k in _namespace(have, invocations, Bound(have.bindings)):
        found.setdefault((name, prefix), []).append((t.starts[k], kind))
    out = []
    for (name, prefix), places in found.items():
        row = {"name": name, "prefix": prefix, "n": len(places), "own": [] if prefix is not None else list(dict.fromkeys(d["symbol_id"] for d in have.declared if d["name"] == name))}
        out.append(row | {"places": [{"byte_start": at, "kind": kind} for at, kind in sorted(places)]} if whole else row)
    return out


def _references(have: Inventory, invocations: list[dict], enclosing, lines: source_text.Lines) -> list[dict]:
    """Names of calls, type clauses, constructors, and reads and writes of bound variables."""
    t, out, bound = have.t, [], Bound(have.bindings)
    named = bound.named

    def add(name: str, prefix: str | None, kind: str, confidence: str, k: int) -> None:
        out.append({"name": name, "prefix": prefix, "kind": kind, "confidence": confidence, "enclosing_symbol_id": enclosing(t.starts[k]), "span": lines.span(t.starts[k], t.ends[k])})

    for r in _namespace(have, invocations, bound):
        add(*r)
    declared = {(b["name"], b["declaration_span"]["byte_start"]) for b in have.bindings}
    for k, text in enumerate(t.texts):
        if text not in named or not is_name(text) or t.at(k - 1) in (".", "?.", "@") or t.at(k + 1) == ":" or (text, t.starts[k]) in declared:
            continue
        if not bound.at(text, t.starts[k]):
            continue
        sign = t.at(k + 1) + (t.at(k + 2) if k + 2 < len(t) and t.starts[k + 2] == t.ends[k + 1] else "")
        simple = t.at(k + 1) == "=" and not sign.startswith("==")
        twice = sign in ("++", "--") or (len(sign) == 2 and sign[1] == "=" and sign[0] in "+-*/%&|^~") or t.at(k - 1) + t.at(k - 2) in ("++", "--")
        if not simple:
            add(text, None, "variable_read", "high", k)
        if simple or twice:
            add(text, None, "variable_write", "high", k)
    out.sort(key=lambda r: (r["span"]["byte_start"], r["span"]["byte_end"], r["kind"], r["name"], r["prefix"] or ""))
    return out
