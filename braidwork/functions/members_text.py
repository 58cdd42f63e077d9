"""Members of types, locals of callables, and where their names are bound.

Ids say where a declaration stands: ``{path}::{kind}:{name}`` at the top, ``{owner}/{kind}:{name}`` below, with #2, #3 for repeats.
"""

from __future__ import annotations

from . import source_text
from .code_tokens import Tokens, is_name

_OWNERS = {"class", "mixin", "enum", "extension", "extension_type"}
CALLABLES = {"function", "method", "constructor", "getter", "setter", "operator"}
_OPENS = frozenset("([{")
_STOPS = frozenset(("=", "=>", "{", ";", "("))
# Words that no declaration's name or type is.
_MODIFIERS = {"static", "final", "const", "late", "var", "abstract", "external", "covariant", "factory"}
_NO_TYPE = {"return", "throw", "yield", "await", "case", "if", "else", "for", "while", "do", "switch", "try", "catch", "finally", "on", "break", "continue", "assert", "new", "default", "rethrow", "import", "export", "part", "library"}


class Inventory:
    """Declarations of one file, each with its id, its parent's id and its exact range."""

    def __init__(self, path: str, masked: bytes, lines: source_text.Lines, declared: list[dict] | None = None) -> None:
        self.t, self.lines, self.path = Tokens(masked), lines, path
        self.rows: list[dict] = []
        self.bindings: list[dict] = []
        self.problems: list[tuple[str, int, int]] = []
        self.ids: dict[str, int] = {}
        self.declared = source_text.declarations(path, masked, lines) if declared is None else declared
        for d in self.declared:
            self._top(d)

    def _id(self, base: str) -> str:
        n = self.ids[base] = self.ids.get(base, 0) + 1
        return base if n == 1 else f"{base}#{n}"

    def _add(self, name: str, kind: str, base: str, parent: str | None, lo: int, hi: int, extends: str | None = None, static: bool = False) -> str:
        """Tokens lo to hi are the declaration."""
        symbol, start, end = self._id(base), self.t.starts[lo], self.t.ends[hi - 1]
        self.rows.append({"name": name, "kind": kind, "symbol_id": symbol, "parent_symbol_id": parent, "extends": extends, "is_static": static, "declaration_span": self.lines.span(start, end)})
        return symbol

    def _end(self, k: int, stop: int) -> int:
        """Behind the declaration that begins at token k: its ``;``, or the ``}`` of a body that no ``=`` or ``=>`` precedes."""
        value = False
        texts, partner = self.t.texts, self.t.partner
        while k < stop:
            text = texts[k]
            if text in _OPENS and partner[k] >= 0:
                end = partner[k]
                if text == "{" and not value:
                    return end + 1
                k = end
            elif text in ("=", "=>"):
                value = True
            elif text == ";":
                return k + 1
            k += 1
        return stop

    def _top(self, d: dict) -> None:
        lo = self.t.first_from(d["span"]["byte_start"])
        if lo >= len(self.t):
            return
        hi = self._end(lo, len(self.t))
        symbol = self._add(d["name"], d["kind"], f"{self.path}::{d['kind']}:{d['name']}", None, lo, hi, d["extends"])
        if d["kind"] in _OWNERS:
            body = next((k for k in range(lo, hi) if self.t.texts[k] == "{" and self.t.partner[k] >= 0), None)
            name = self.t.texts.index(d["name"], lo, hi)
            after = self.t.angles_end(name + 1)
            if d["kind"] in ("class", "enum") and self.t.at(after) == "(":
                self.problems.append(("unsupported_primary_constructor", self.t.starts[lo], self.t.ends[hi - 1]))
            if body is not None:
                self._members(d["name"], d["kind"], symbol, body + 1, self.t.partner[body])
        elif d["kind"] == "function":
            self._callable(symbol, lo, hi)

    def _members(self, owner: str, kind: str, parent: str, lo: int, hi: int) -> None:
        if kind == "enum":  # values come first, up to a semicolon
            cut = self.t.split(lo, hi, ";")
            if len(cut) < 2:
                return
            lo = cut[0][1] + 1
        while lo < hi:
            end = self._end(lo, hi)
            self._member(owner, parent, lo, end)
            lo = end

    def _member(self, owner: str, parent: str, lo: int, hi: int) -> None:
        t = self.t
        while lo < hi and t.texts[lo] == "@":  # annotations
            lo += 2
            while t.at(lo) == ".":
                lo += 2
            if t.at(lo) == "(" and t.partner[lo] >= 0:
                lo = t.partner[lo] + 1
        if lo >= hi or t.texts[lo] in ";}":
            return
        words, k = [], lo
        static = False
        while k < hi and t.texts[k] in _MODIFIERS:
            static |= t.texts[k] == "static"
            words.append(t.texts[k])
            k += 1
        if k >= hi:
            return
        add = lambda name, kind: self._add(name, kind, f"{parent}/{kind}:{name}", parent, lo, hi, static=static)
        if t.at(k) == owner and t.at(k + 1) in ("(", "."):
            name = owner
            if t.at(k + 1) == "." and is_name(t.at(k + 2)):
                name = f"{owner}.{t.texts[k + 2]}"
            self._callable(add(name, "constructor"), lo, hi)
            return
        if t.at(k) in ("new", "this") and t.at(k + 1) in ("(", "."):
            self.problems.append(("unsupported_concise_constructor", t.starts[lo], t.ends[hi - 1]))
            return
        stop = k
        while stop < hi and t.texts[stop] not in _STOPS:
            stop += 1
        for j in range(k, stop):
            if t.texts[j] in ("get", "set") and is_name(t.at(j + 1)) and j + 1 < hi:
                self._callable(add(t.texts[j + 1], "getter" if t.texts[j] == "get" else "setter"), lo, hi)
                return
            if t.texts[j] == "operator" and not is_name(t.at(j + 1)):
                sign = next((x for x in range(j + 1, hi) if t.texts[x] == "("), hi)
                self._callable(add("".join(t.texts[j + 1 : sign]), "operator"), lo, hi)
                return
        paren = stop
        if t.at(paren) == "(" and paren > k:
            name = paren - 1
            while name > k and t.texts[name] == ">":  # type parameters
                while name > k and t.texts[name] != "<":
                    name -= 1
                name -= 1
            if is_name(t.texts[name]) and t.texts[name] not in _NO_TYPE:
                self._callable(add(t.texts[name], "method"), lo, hi)
                return
        for a, b in t.split(k, hi - 1 if t.at(hi - 1) == ";" else hi, ","):
            eq = next((j for j in range(a, b) if t.texts[j] == "="), b)
            if eq > a and is_name(t.texts[eq - 1]) and t.texts[eq - 1] not in _NO_TYPE:
                add(t.texts[eq - 1], "field")

    def _callable(self, symbol: str, lo: int, hi: int) -> None:
        """Parameters and locals of the callable of tokens lo to hi."""
        t = self.t
        body, open_ = lo, None
        while body < hi and t.texts[body] not in ("{", "=>"):
            if t.texts[body] == "(" and t.partner[body] >= 0:
                open_ = body if open_ is None else open_
                body = t.partner[body]
            body += 1
        if open_ is not None:
            close = t.partner[open_]
            self._parameters(symbol, open_ + 1, close, t.ends[close], t.ends[hi - 1])
        if t.at(body) == "{" and t.partner[body] >= 0:
            self._locals(symbol, body + 1, t.partner[body])

    def _bind(self, name: str, kind: str, owner: str, lo: int, hi: int, scope: tuple[int, int]) -> None:
        symbol = self._id(f"{owner}/{'parameter' if kind == 'parameter' else 'local_variable'}:{name}")
        span = self.lines.span(self.t.starts[lo], self.t.ends[hi - 1])
        self.bindings.append({"name": name, "kind": kind, "symbol_id": symbol, "enclosing_symbol_id": owner, "declaration_span": span, "scope_start": scope[0], "scope_end": scope[1]})
        if kind == "local_variable":
            self.rows.append({"name": name, "kind": kind, "symbol_id": symbol, "parent_symbol_id": owner, "extends": None, "is_static": False, "declaration_span": span})

    def _parameters(self, owner: str, lo: int, hi: int, scope_start: int, scope_end: int) -> None:
        for a, b in self.t.split(lo, hi, ","):
            while a < b and self.t.texts[a] in "[{":
                self._parameters(owner, a + 1, self.t.partner[a] if self.t.partner[a] >= 0 else b, scope_start, scope_end)
                a = b
            names = self.t.texts[a : next((j for j in range(a, b) if self.t.texts[j] in ("=", ":", "(")), b)]
            if names and is_name(names[-1]) and "." not in names:  # this.x and super.x bind nothing here
                at = a + len(names) - 1
                self._bind(names[-1], "parameter", owner, at, at + 1, (scope_start, scope_end))

    def _locals(self, owner: str, lo: int, hi: int) -> None:
        t, k, begins = self.t, lo, True
        texts, blocks = t.texts, [hi]
        while k < hi:
            text = texts[k]
            if text == "{" and t.partner[k] >= 0:
                blocks.append(t.partner[k])
            elif text == "}" and blocks and blocks[-1] == k:
                blocks.pop()
            elif begins and is_name(text) and (found := self._local(k, hi)):
                name, end = found
                stop = next((j for j in range(end, hi) if t.texts[j] in (";", "}") or t.texts[j] == "{"), hi)
                if t.at(end) == "=":
                    stop, j = end, end
                    while j < hi and t.texts[j] not in (";", ","):
                        j = t.partner[j] if t.texts[j] in "([{" and t.partner[j] >= 0 else j
                        j += 1
                    stop = j
                    scope = t.starts[min(stop, hi)] if stop < len(t) else t.ends[-1]
                else:
                    scope = t.ends[end - 1]
                self._bind(name, "local_variable", owner, k, max(end, stop), (scope, t.starts[blocks[-1]] if blocks[-1] < len(t) else t.ends[-1]))
            begins = text in ("{", "}", ";")
            k += 1

    def _local(self, k: int, hi: int) -> tuple[str, int] | None:
        """The name that a statement at token k declares, and the token behind it."""
        t, typed = self.t, False
        while t.at(k) in ("late", "final", "const", "var"):
            typed, k = True, k + 1
        if t.at(k) in _NO_TYPE or not is_name(t.at(k)):
            return None
        if typed and t.at(k + 1) in ("=", ";", ","):
            return t.texts[k], k + 1
        j = k + 1
        while t.at(j) == "." and is_name(t.at(j + 1)):
            j += 2
        j = t.angles_end(j)
        j += t.at(j) == "?"
        if j < hi and is_name(t.at(j)) and t.at(j) not in _NO_TYPE and t.at(j + 1) in ("=", ";", ","):
            return t.texts[j], j + 1
        return None
