"""Small documents with every odd case, and plain versions of what operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, k: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random documents, copies and edits of them, nulls, blanks, repeated rows, one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    text = lambda m: "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))) for _ in range(m))
    out = [text(rng.randrange(1, 8)) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(out[:n]).split(" ")
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [None, "", "  \n\t ", "one", "One", "two words", text(300), out[0], out[0].upper(), "a b c d e", "a b c d e f"]
    rows = [(k * 3 % 1009, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(out)]
    return [*rows, rows[0], rows[5], (None, "no id here at all", None, None, None), (None, None, None, None, None)]


def distinct_ids(rows: list[tuple]) -> dict:
    """One row for each id, as repeated rows are one document."""
    return {r[0]: r[1] for r in rows}


def order(doc_id: int | None) -> int:
    return -(1 << 63) if doc_id is None else doc_id
