"""Facts of one Dart source text: a mask of its code, lines, directives, declarations, diagnostics.

Spans are UTF-8 byte ranges, half open; lines and columns count from 1, columns in code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

_OPENING = re.compile(rb"""//[^\r\n]*|/\*|'{3}|"{3}|'|\"""")
_WORD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_COMMENT_EDGE = re.compile(rb"/\*|\*/")


def _closing(quote: bytes, raw: bool) -> re.Pattern[bytes]:
    """What follows an opening quote, up to its end: a group ``end`` if it has one. A short string ends with its line at the latest."""
    escape = b"" if raw else rb"\\.|"
    plain = rb"(?!" + quote + rb")." if len(quote) == 3 else rb"[^\r\n" + quote + (b"" if raw else rb"\\") + rb"]"
    return re.compile(rb"(?:" + escape + plain + rb")*(?P<end>" + quote + rb")?", re.S)


_CLOSING = {(quote, raw): _closing(quote, raw) for quote in (b"'''", b'"""', b"'", b'"') for raw in (False, True)}
_VISIBLE = re.compile(rb"[^\r\n]")
_BLOCK_END = "unterminated_block_comment"
_STRING_END = "unterminated_string"


def mask(source: bytes) -> tuple[bytes, list[tuple[str, int, int]]]:
    """source with comments and strings blanked, line ends kept; (code, start, end) of what never ends."""
    out, at, open_ = [], 0, []
    while (m := _OPENING.search(source, at)) is not None:
        start, token = m.start(), m[0]
        if token.startswith(b"//"):
            end = m.end()
        elif token == b"/*":
            depth, end = 1, len(source)
            for edge in _COMMENT_EDGE.finditer(source, m.end()):
                depth += 1 if edge[0] == b"/*" else -1
                if not depth:
                    end = edge.end()
                    break
            if depth:
                open_.append((_BLOCK_END, start, len(source)))
        else:
            raw = start > at and source[start - 1] == 114 and (start < 2 or source[start - 2] not in _WORD)  # an r that ends no word
            start -= raw
            close = _CLOSING[token, raw].match(source, m.end())
            end = close.end()
            if close["end"] is None:
                open_.append((_STRING_END, start, len(source)))
        hidden = source[start:end]
        out += [source[at:start], _VISIBLE.sub(b" ", hidden) if b"\n" in hidden or b"\r" in hidden else b" " * len(hidden)]
        at = end
    return b"".join([*out, source[at:]]), open_


class Lines:
    """Where lines begin, and spans from byte ranges."""

    def __init__(self, source: bytes) -> None:
        self.source = source
        self.ascii = source.isascii()
        pieces = source.split(b"\n")
        if len(pieces) > 1 and not pieces[-1]:
            pieces.pop()
        self.pieces = pieces
        self.starts = list(accumulate([len(p) + 1 for p in pieces[:-1]], initial=0))

    def texts(self) -> list[bytes]:
        """Lines without their ends."""
        return [p[:-1] if p.endswith(b"\r") else p for p in self.pieces] if b"\r" in self.source else self.pieces

    def place(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.starts, at) - 1
        start = self.starts[k]
        return k + 1, (min(at, len(self.source)) - start if self.ascii else len(self.source[start:at].decode("utf-8", "replace"))) + 1

    def span(self, start: int, end: int) -> dict:
        (a, b), (c, d) = self.place(start), self.place(end)
        return {"byte_start": start, "byte_end": end, "start_line": a, "start_column": b, "end_line": c, "end_column": d}


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_QUOTED = re.compile(r"""\s*r?(?:'([^']*)'|"([^"]*)")""")
_BRANCH = re.compile(r"\s*if\s*\(([^)]*)\)")
_STARTS = re.compile(rb"\s*(import|export)(\s|$)")
_PART_OF = re.compile(r"part\s+of\s+(?:['\"]([^'\"]*)['\"]|([A-Za-z_][\w.]*))")
_PART = re.compile(r"part\s+r?['\"]([^'\"]*)['\"]")
_LIBRARY = re.compile(rf"library(?:\s+({_NAME}(?:\.{_NAME})*))?\s*;")
_CONSTANT = re.compile(rf"(?:const|final)\s+(?:String\s+)?({_NAME})\s*=\s*(r?)(?:'([^']*)'|\"([^\"]*)\")\s*;")


def directive(text: str, kind: str) -> dict | None:
    """uri, configurations, deferred, prefix and combinators of an import's or export's text."""
    m = _QUOTED.match(text, len(kind))
    if m is None:
        return None
    branches, at = [], m.end()
    while (cond := _BRANCH.match(text, at)) and cond[1].strip() and (target := _QUOTED.match(text, cond.end())):
        branches.append({"condition": cond[1].strip(), "uri": target[1] if target[1] is not None else target[2]})
        at = target.end()
    tokens = re.split(r"[\s,;]+", text[at:].strip(" \t\r\n;,"))
    out = {"uri": m[1] if m[1] is not None else m[2], "configurations": branches, "is_deferred": False, "prefix": None, "combinators": []}
    names: list[str] | None = None
    after_as = False
    for t in tokens:
        if after_as:
            out["prefix"], after_as = (t if re.fullmatch(_NAME, t) else None), False
        elif t in ("show", "hide"):
            names = []
            out["combinators"].append({"kind": t, "names": names})
        elif names is not None:
            if re.fullmatch(_NAME, t):
                names.append(t)
        elif kind == "import" and t == "deferred":
            out["is_deferred"] = True
        elif kind == "import" and t == "as":
            after_as = True
    return out


_TYPE_KINDS = [
    ("class", rf"(?:(?:abstract|sealed|base|interface|final|mixin)\s+)*class\s+({_NAME})"), ("mixin", rf"(?:base\s+)?mixin\s+({_NAME})"), ("enum", rf"enum\s+({_NAME})"),
    ("extension_type", rf"extension\s+type\s+(?:const\s+)?({_NAME})"), ("extension", rf"extension\s+({_NAME})"), ("typedef", rf"typedef\s+({_NAME})\s*(?:<[^=]*>)?\s*="), ("typedef", rf"typedef\s+(?:[^(=]*\s)?({_NAME})\s*(?:<[^(=]*>)?\("),
]
#: With a word without which none matches.
_TYPES = [(k, k.split("_")[0], re.compile(p)) for k, p in _TYPE_KINDS]
_NO_BRACKETS = bytes(set(range(256)) - set(b"()[]{}"))
_NO_OPENINGS = bytes(set(range(256)) - set(b"([{"))
_VARIABLE = re.compile(rf"(?:late\s+)?(?:const|final|var)\s+(?:[^=;(]*\s)?({_NAME})\s*(?:=|;|$)")
_FUNCTION = re.compile(rf"(?:external\s+)?(?:[\w<>,.?\[\]\s]*\s)?(?:get\s+)?({_NAME})\s*(?:<[^()]*>)?\(")
_EXTENDS = re.compile(r"\bextends\s+([\w.]+)")
_NOT_DECLARED = re.compile(r"@|(?:import|export|part|library|if|for|while|switch|return|assert)\b")
#: Code of lines that say something about their file; constants are looked for in lines that begin with one of _CONSTANT's words.
_TELLS = re.compile(rb"import|export|library|part|<<<<<<<|>>>>>>>")
_CONSTANT_WORDS = (b"const", b"final")


def declarations(path: str, masked: bytes, lines: Lines, texts: list[bytes] | None = None) -> list[dict]:
    """Top-level types, variables and functions: lines at brace depth 0 that begin none before. texts: the lines of masked, if they are known."""
    out, depth, ids, inside = [], 0, {}, False
    for start, raw in zip(lines.starts, Lines(masked).texts() if texts is None else texts, strict=False):
        text = raw.decode("utf-8", "replace") if depth == 0 and not inside else ""
        if text.strip() and not text[:1].isspace() and not _NOT_DECLARED.match(text):
            found = next(((k, m) for k, word, p in _TYPES if word in text and (m := p.match(text))), None)
            if found is None and (m := _VARIABLE.match(text)):
                found = ("variable", m)
            if found is None and "(" in text and "=" not in text.split("(")[0] and (m := _FUNCTION.match(text)):
                found = ("function", m)
            if found:
                kind, m = found
                base = f"{path}::{kind}:{m[1]}"
                ids[base] = ids.get(base, 0) + 1
                extends = _EXTENDS.search(text) if kind == "class" else None
                out.append({"name": m[1], "kind": kind, "symbol_id": base + (f"#{ids[base]}" if ids[base] > 1 else ""), "extends": extends and extends[1], "span": lines.span(start, start + len(raw))})
                inside = True
        if brackets := raw.translate(None, _NO_BRACKETS):
            depth = max(0, depth + 2 * len(brackets.translate(None, _NO_OPENINGS)) - len(brackets))
        if inside and depth == 0 and raw.rstrip().endswith((b";", b"}")):
            inside = False
    return out


class Bytes(Lines):
    """Lines whose spans are byte ranges alone."""

    def span(self, start: int, end: int) -> dict:
        return {"byte_start": start, "byte_end": end}


def facts(path: str, source: str) -> dict:
    """All facts of a file."""
    raw = source.encode("utf-8", "surrogatepass")
    masked, never_end = mask(raw)
    return read(path, masked, never_end, Lines(raw))


def read(path: str, masked: bytes, never_end: list[tuple[str, int, int]], lines: Lines, constants: bool = True) -> dict:
    """facts of a text that is masked already; constants are left empty if they are not wanted."""
    code = Lines(masked).texts()
    out = {"path": path, "library": None, "part_of_uri": None, "part_of_name": None, "directives": [], "parts": [], "constants": [], "declarations": declarations(path, masked, lines, code)}
    problems = [(c, lines.span(a, b)) for c, a, b in never_end]
    pending: tuple[str, int, list[str]] | None = None
    texts, end = lines.texts(), 0

    def close(last: int) -> None:
        kind, start, collected = pending
        span = lines.span(start, last)
        got = directive(" ".join(collected), kind)
        if got is not None:
            out["directives"].append({"kind": kind, **got, "span": span})

    for start, text, shown in zip(lines.starts, texts, code, strict=False):
        end = start + len(text)
        if pending is None and _TELLS.search(shown) is None and not (constants and text.startswith(_CONSTANT_WORDS)):
            continue
        line, span = text.decode("utf-8", "replace"), None
        begins = _STARTS.match(shown)
        if pending is not None:
            pending[2].append(line.strip())
        elif begins:
            pending = (begins[1].decode(), start, [line.strip()])
        if pending is not None and b";" in shown:
            close(end)
            pending = None
        bare = shown.decode("utf-8", "replace").strip()
        if "<<<<<<<" in bare or ">>>>>>>" in bare:
            problems.append(("merge_conflict_marker", lines.span(start, end)))
        if m := _LIBRARY.match(bare):
            out["library"] = m[1] or ""
        elif re.match(r"part\s+of\b", bare):
            if m := _PART_OF.match(line.strip()):
                out["part_of_uri"], out["part_of_name"] = m[1], m[2]
        elif re.match(r"part\s", bare) and (m := _PART.match(line.strip())):
            span = lines.span(start, end)
            out["parts"].append({"uri": m[1], "span": span})
        if constants and (m := _CONSTANT.match(line)):
            out["constants"].append({"name": m[1], "value": m[3] if m[3] is not None else m[4], "span": lines.span(start, end)})
    if pending is not None:
        close(end)
        problems.append(("directive_missing_semicolon", lines.span(pending[1], end)))
    out["diagnostics"] = [{"code": c, "severity": "warning", "span": s} for c, s in problems]
    return out
