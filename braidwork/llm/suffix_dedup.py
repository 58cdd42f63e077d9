"""Suffix-array dedup: a sparse suffix array over words finds the passages that repeat.

1. Suffixes are retained at minimisers only: positions whose run of ``GRAM`` words has the least hash
   among ``MIN_WORDS - GRAM + 1`` neighbouring ones. Content alone selects them, so every copy of a
   passage of MIN_WORDS words retains the same suffix within it; about one position in 16 is retained.
2. Suffixes whose first GRAM words occur once have no match and go; the others are read from the
   documents again, with ``REACH`` words to either side.
3. They are range-partitioned and sorted by the words behind and before, then by document and place, so that equal
   suffixes, however many, are dealt over many tasks. Suffixes equal in all those words are neighbours, and only the first and
   the last of them in a task go on; the others repeat in every window and are first in none.
4. Suffixes that go on are equal in some windows of MIN_WORDS words around the gram only, and not always to a neighbour. Each such
   window belongs to its first least gram; windows are counted by a 64-bit hash, with the least and the greatest place, in partial aggregates.
5. Overlapping and touching windows of a document are one passage if all of them, or none, are the first of their equals.

Defined cases: null, empty and short texts (fewer than MIN_WORDS words) have no passage; a passage that
repeats within one document counts as well; rows repeated under one doc_id match each other and give
the passages once; equal suffixes are ordered by document and place; a null doc_id counts as the
smallest; an empty table gives no rows; ``dedup_passages`` keeps other columns untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
GRAM = 20
REACH = 32
#: Grams in a window of MIN_WORDS words.
SPREAD = MIN_WORDS - GRAM + 1
FIRST = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, by differences of running sums of the words' hashes times powers."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)])
    return common.mixed((sums[k:] - sums[:-k]) * _powers(_BACK, n - k + 1))


def _sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each run of w numbers, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """The positions that are the least of some window of that many; all of equals."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least = _sliding(grams, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == grams)


def _hashes(text: str | None) -> np.ndarray:
    return common.text_hashes(text)


def _retained(batches):
    for batch in batches:
        ids, places, grams, held = [], [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            g = gram_hashes(_hashes(text.as_py()), GRAM)
            at = minimisers(g, SPREAD)
            if len(at):
                ids.append(np.full(len(at), doc_id, np.int64))
                places.append(at)
                grams.append(g[at])
                held += len(at)
        if held:
            yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(places)), pa.array(np.concatenate(grams).view(np.int64))], names=["doc_id", "place", "gram"])


_SUFFIX = pa.schema([("gram", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_SUFFIX_DDL = "gram long, right binary, left binary, doc_id long, place long, start long, n long"


def owners(grams: np.ndarray, window: int) -> np.ndarray:
    """The first least position of each window of that many; it never falls."""
    views = np.lib.stride_tricks.sliding_window_view(grams, window) if len(grams) >= window else np.zeros((0, window), np.uint64)
    parts = [lo + np.arange(len(v)) + v.argmin(1) for lo in range(0, len(views), 2000) for v in (views[lo : lo + 2000],)]  # argmin copies
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _suffixes(batches):
    """The words after and, in reverse, before each wanted gram, four bytes of hash each, and the n windows from start on that it is the first least gram of."""
    for batch in batches:
        for lo in range(0, len(batch), 100):
            rows: list[tuple] = []
            part = batch.slice(lo, 100)
            for doc_id, text, want in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("want").to_pylist(), strict=True):
                h = _hashes(text.as_py())
                raw = (h >> np.uint64(32)).astype(">u4")
                unsigned = gram_hashes(h, GRAM)
                grams, own = unsigned.view(np.int64), owners(unsigned, SPREAD)
                at = np.array([w["place"] for w in want], np.int64)
                starts, stops = np.searchsorted(own, at).tolist(), np.searchsorted(own, at, "right").tolist()
                for w, start, stop in zip(want, starts, stops, strict=True):
                    k = w["place"]
                    if start < stop and k < len(grams) and grams[k] == w["gram"]:  # else it is of another row of this doc_id
                        rows.append((w["gram"], raw[k + GRAM : k + GRAM + REACH].tobytes(), raw[max(0, k - REACH) : k][::-1].tobytes(), doc_id, k, start, stop - start))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SUFFIX.types, strict=True)], schema=_SUFFIX)


def _sums(contexts: list[bytes], factors: np.ndarray) -> np.ndarray:
    """A hash of each context's first 0, 1, 2, ... words."""
    words = np.frombuffer(b"".join(c.ljust(4 * REACH, b"\0") for c in contexts), ">u4").reshape(-1, REACH).astype(np.uint64)
    return np.cumsum(np.concatenate([np.zeros((len(words), 1), np.uint64), common.mixed(words + np.uint64(1)) * factors], 1), axis=1, dtype=np.uint64)


_FACTORS = common.mixed(np.arange(1, 2 * REACH + 1, dtype=np.uint64)) | np.uint64(1)
_WINDOW_DDL = "doc_id long, start int, n int, windows array<long>"


def _windows(rows: list[tuple], ends: list[bool]) -> pa.RecordBatch:
    """The hashes of the windows from start on, one for each n windows: of each of them for suffixes at an end of a run, of the first one for others."""
    gram, right, left, doc, place, start, n = zip(*rows, strict=True)
    doc, place, start, n = (np.array(x, np.int64) for x in (doc, place, start, n))
    after, before = _sums(right, _FACTORS[:REACH]), _sums(left, _FACTORS[REACH:])
    # the window with r words behind the gram has SPREAD - 1 - r before it
    hashes = common.mixed(common.mixed(np.array(gram, np.int64).view(np.uint64)[:, None] + before[:, SPREAD - 1 :: -1]) + after[:, :SPREAD])
    r, first = np.arange(SPREAD), (SPREAD - 1 - (place - start))[:, None]
    size = np.where(ends, n, 1)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(hashes[(r >= first) & (r < first + size[:, None])].view(np.int64)))
    return pa.record_batch([pa.array(doc), pa.array(start, pa.int32()), pa.array(np.where(ends, 1, n), pa.int32()), lists], names=["doc_id", "start", "n", "windows"])


def _walk(batches):
    """The windows of a sorted range. Of suffixes with all words around equal, the windows of the first and the last
    are the least and the greatest; one between them repeats in all its windows and is first in none."""
    last, opens = None, True  # the suffix before, and whether it is the first of its equals
    for batch in batches:
        for lo in range(0, len(batch), 1000):
            rows, ends = [], []
            for row in zip(*batch.slice(lo, 1000).to_pydict().values(), strict=True):
                if last is not None:
                    if row == last:  # a row repeated under its doc_id
                        continue
                    same = row[:3] == last[:3]
                    rows.append(last)
                    ends.append(opens or not same)
                    opens = not same
                last = row
            if rows:
                yield _windows(rows, ends)
    if last is not None:
        yield _windows([last], [True])


def stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, like_doc_id, is_first): stretches of words all of whose windows of MIN_WORDS are somewhere else too,
    and are all, or none of them, the first of their equals by doc_id and place."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    retained = common.written(docs.mapInArrow(_retained, "doc_id long, place long, gram long"), "retained")
    # written, so that the join with it is dealt out anew and a gram that very many documents share can be split
    repeated = common.written(retained.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    wanted = retained.join(repeated, "gram").groupBy("doc_id").agg(F.collect_set(F.struct("place", "gram")).alias("want"))  # a document's own
    suffixes = docs.where("text is not null").join(wanted, "doc_id").select("doc_id", "text", "want").mapInArrow(_suffixes, _SUFFIX_DDL)
    order = ["gram", "right", "left", "doc_id", "place"]
    packed = common.written(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).select(*_SUFFIX.names).mapInArrow(_walk, _WINDOW_DDL), "windows")
    places = common.Places(docs)
    windows = packed.select("doc_id", "start", "n", F.posexplode("windows").alias("at", "window")).select("window", places.id("doc_id", "(start + at)").alias("id"), "n")
    several = windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("greatest")).where("least <> greatest")
    found = windows.join(common.written(several, "repeated-windows"), "window").withColumn("is_first", F.col("id") == F.col("least"))
    like = F.when(F.col("is_first"), places.doc_id("greatest")).otherwise(places.doc_id("least"))
    return found.select(places.doc_id("id").alias("doc_id"), places.line_no("id").alias("start"), "n", like.alias("like_doc_id"), "is_first").selectExpr("doc_id", "start", f"start + n + {MIN_WORDS - 1} as end", "like_doc_id", "is_first")


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, like_doc_id, is_first): each document's repeated passages, in words from 0.

    is_first: each of its runs of MIN_WORDS words is here first, by doc_id and place; otherwise none is. A passage that is first
    can overlap one that is not. like_doc_id: the smallest id that has the passage's first MIN_WORDS words, or, where they are first, the largest.
    """
    own = Window.partitionBy("doc_id", "is_first").orderBy("start", "end")
    seen = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parted = stretches(docs).withColumn("new", (seen.isNull() | (F.col("start") > seen)).cast("int")).withColumn("part", F.sum("new").over(own))
    merged = parted.groupBy("doc_id", "is_first", "part").agg(F.min(F.struct("start", "like_doc_id")).alias("head"), F.max("end").alias("end"))
    null_again = lambda c: F.when(F.col(c) != FIRST, F.col(c))
    return merged.select(null_again("doc_id").alias("doc_id"), F.col("head.start").cast("long").alias("start"), (F.col("end") - F.col("head.start")).cast("long").alias("n_words"), null_again("head.like_doc_id").alias("like_doc_id"), "is_first")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage taken out of ``text`` but for words of one that is first there; all rows and columns stay."""
    gone = passages(docs).groupBy(F.coalesce("doc_id", F.lit(FIRST)).alias("__id")).agg(F.collect_list(F.struct("start", "n_words", "is_first")).alias("__gone"))

    @F.pandas_udf("string")
    def cut(texts, lists):  # noqa: ANN001, ANN202
        import re

        import pandas as pd

        def one(text: str | None, spans: list | None) -> str | None:
            if text is None or spans is None:
                return text
            words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            out = np.zeros(len(words) + 2, np.int8)  # a word that does not go at either side
            for s in sorted(spans, key=lambda s: s["is_first"]):
                out[1:-1][s["start"] : s["start"] + s["n_words"]] = not s["is_first"]
            turns = np.flatnonzero(np.diff(out)).tolist()
            for start, end in reversed(list(zip(turns[::2], turns[1::2], strict=True))):
                text = text[: words[start][0]] + text[words[end - 1][1] :]
            return text

        return pd.Series([one(t, s) for t, s in zip(texts, lists, strict=True)])

    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    out = docs.withColumn("__own", own).join(gone, F.col("__own") == F.col("__id"), "left")
    return out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cut("text", "__gone"))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: see passages."""
    return passages(common.documents(spark, sf_dir))
