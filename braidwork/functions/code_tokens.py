"""Tokens of a masked source text, with the partner of every bracket."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

_TOKEN = re.compile(r"([A-Za-z_][A-Za-z0-9_]*|\d[\w.]*|\?\.|=>|[^\s\w])", re.ASCII)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = frozenset("()[]{}")


def is_name(text: str) -> bool:
    return text.isidentifier() and text.isascii()


class Tokens:
    """Texts and byte ranges of tokens; ``partner`` is the place of a bracket's other one, -1 for one that has none."""

    def __init__(self, masked: bytes) -> None:
        # What lies between tokens and the tokens take turns; a byte is a character.
        pieces = _TOKEN.split(masked.decode("latin-1"))
        places = list(accumulate(map(len, pieces)))
        self.masked = masked
        self.texts = pieces[1::2]
        self.starts = places[0:-1:2]
        self.ends = places[1::2]
        if not masked.isascii():
            self.texts = [t if t.isascii() else "\ufffd" for t in self.texts]
        self.partner = [-1] * len(self.texts)
        open_: dict[str, list[int]] = {c: [] for c in _PAIRS.values()}
        for k, t in enumerate(self.texts):
            if t not in _BRACKETS:
                continue
            if t in _PAIRS:
                open_[_PAIRS[t]].append(k)
            elif open_[t]:
                j = open_[t].pop()
                self.partner[j], self.partner[k] = k, j

    def __len__(self) -> int:
        return len(self.texts)

    def at(self, k: int) -> str:
        return self.texts[k] if 0 <= k < len(self.texts) else ""

    def first_from(self, byte: int) -> int:
        """The first token that begins at this byte or later."""
        return bisect_left(self.starts, byte)

    def angles_end(self, k: int) -> int:
        """Behind the type arguments that open at token k; k itself if none do."""
        texts = self.texts
        if not 0 <= k < len(texts) or texts[k] != "<":
            return k
        depth, j = 0, k
        while j < len(texts) and texts[j] not in "{};":
            depth += (texts[j] == "<") - (texts[j] == ">")
            j += 1
            if not depth:
                return j
        return k

    def split(self, lo: int, hi: int, mark: str) -> list[tuple[int, int]]:
        """The runs of tokens of [lo, hi) between marks that stand in no bracket or type argument list."""
        out, begin, angles, k = [], lo, 0, lo
        texts, partner = self.texts, self.partner
        while k < hi:
            t = texts[k]
            if t in _PAIRS and lo <= partner[k] < hi:
                k = partner[k]
            elif t == "<":
                angles += 1
            elif t == ">":
                angles = max(0, angles - 1)
            elif t == mark and not angles:
                out.append((begin, k))
                begin = k + 1
            k += 1
        return [*out, (begin, hi)]
