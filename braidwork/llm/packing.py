"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Texts are tokenised once, cut into pieces of at most ``capacity`` tokens and written. A length is an
integer of at most ``capacity``, so the whole bin-packing instance is a histogram of at most ``capacity``
rows, however many documents there are; the driver packs that histogram, as patterns with
multiplicities, and never sees a document. Pieces then find their places by their rank among the pieces
of equal length. Ranks are counted in salted groups of about ``GROUP`` pieces, so that a length that
holds a third of all pieces is spread over many tasks.

Reduction: in order of falling length, a piece is fixed with a companion set that dominates all others:
alone if nothing fits beside it; with a piece that fills the bin exactly; with the largest fitting piece
if no two fit, or if no three fit and no fitting pair is longer. What is left is packed best-fit
decreasing, which on a histogram takes a step for each pair of a length and a free space.

Defined cases: a null or empty text is the end id alone, one token; repeated rows are packed as often as
they occur; ties in length are broken by doc_id and piece; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked in one task, about.
GROUP = 10_000

# The public pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are the same in every Unicode version and regex engine; texts of these alone take the fast encoder.
SETTLED = re.compile("[\x00-\x7f\xa1-\xac\xae-\xffĀ-ɏ]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids of a byte-level BPE vocabulary as ``tokenizers`` gives them.

    Where the vocabulary's ids are also its merge ranks, texts of settled characters go through
    ``tiktoken`` with the same vocabulary, which gives the same ids in a third of the time; all other
    texts, those that hold an added token's literal among them, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = self._fast(path)

    def _fast(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        special = {x["content"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if len(ranks) != 256 + len(merges) or any(a >= b for a, b in zip(made, made[1:], strict=False)) or (made and made[0] < 256):
            return None
        return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> array:
        if not text:
            return array("I")
        if self.fast and (text.isascii() or SETTLED.fullmatch(text)) and not any(t in text for t in self.added):
            return array("I", self.fast.encode_ordinary(text))
        return array("I", self.slow.encode(text, add_special_tokens=False).ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones behind a first that may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every text, followed by the end id."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.ids(text.as_py())
                ids.append(END_ID)
                raw = memoryview(np.frombuffer(ids, np.uintc).astype("<u4", copy=False)).cast("B")
                rows += [(doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


@dataclass
class Segment:
    """Pieces of one length, by rank from ``rank`` on: ``each`` of them in each of ``bins`` bins."""

    length: int
    rank: int
    each: int
    bins: int
    first_bin: int
    offset: int


class _Stock:
    """How many pieces there are of each length; lengths in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {k: int(v) for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.left)

    def give(self, size: int) -> None:
        if size not in self.left:
            self.left[size] = 0
            insort(self.sizes, size)
        self.left[size] += 1

    def take(self, size: int, n: int) -> None:
        if not n:
            return
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def largest(self, most: int) -> int | None:
        k = bisect_left(self.sizes, most + 1)
        return self.sizes[k - 1] if k else None

    def smallest(self, n: int) -> int | None:
        """The sum of the n smallest pieces, None with fewer."""
        total = 0
        for size in self.sizes:
            k = min(n, self.left[size])
            total, n = total + k * size, n - k
            if not n:
                return total
        return None

    def best_pair(self, most: int) -> int:
        """The largest sum, up to most, of two pieces; 0 if none fit."""
        best, i, j = 0, 0, bisect_left(self.sizes, most + 1) - 1
        while i <= j:
            total = self.sizes[i] + self.sizes[j]
            if total > most:
                j -= 1
            elif i == j and self.left[self.sizes[i]] < 2:
                break
            else:
                best = max(best, total)
                i += 1
        return best


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Bins that dominate all alternatives, as (pieces of each length, bins); and the pieces that are left."""
    stock, fixed = _Stock(counts), []
    j = stock.largest(capacity)
    while j is not None:
        n = stock.left[j]
        stock.take(j, 1)  # what is left are the companions of one such piece, longer undecided ones included
        room = capacity - j
        k = stock.largest(room)
        two, three = stock.smallest(2), stock.smallest(3)
        if k is None:
            fixed.append(({j: 1}, n))
            stock.take(j, n - 1)
        elif k == room or two is None or two > room or ((three is None or three > room) and stock.best_pair(room) <= k):
            # as long as there are both: with fewer pieces about, nothing else comes to fit
            times = n // 2 if k == j else min(n, stock.left[k])
            fixed.append(({j: 2} if k == j else {j: 1, k: 1}, times))
            stock.take(j, 2 * times - 1 if k == j else times - 1)
            if k != j:
                stock.take(k, times)
        else:
            stock.give(j)
            j = stock.largest(j - 1)
            continue
        j = stock.largest(j)
    return fixed, stock.left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: (pieces of each length, bins)."""
    spaces: list[int] = []
    by_space: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(pattern: dict[int, int], space: int, bins: int) -> None:
        if space not in by_space:
            by_space[space] = []
            insort(spaces, space)
        by_space[space].append((pattern, bins))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                pattern, bins = by_space[space].pop()
                if not by_space[space]:
                    del by_space[space]
                    del spaces[at]
            else:
                pattern, space, bins = {}, capacity, n
            each = space // size
            full = min(bins, n // each)
            if full:
                put(pattern | {size: each}, space - each * size, full)
            n -= full * each
            if full < bins:
                if n:  # fewer than each are left: one bin takes them
                    put(pattern | {size: n}, space - n * size, 1)
                    full, n = full + 1, 0
                if full < bins and pattern:
                    put(pattern, space, bins - full)
    return [x for group in by_space.values() for x in group]


def packed(counts: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """Where the pieces of each length go, by rank."""
    fixed, left = reduced(counts, capacity)
    out, rank, first = [], dict.fromkeys(counts, 0), 0
    for pattern, bins in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for size in sorted(pattern, reverse=True):
            out.append(Segment(size, rank[size], pattern[size], bins, first, offset))
            rank[size] += pattern[size] * bins
            offset += pattern[size] * size
        first += bins
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut, with sequence_id and offset. cut: written pieces, as they are read three times."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    if not histogram:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salts = spark.createDataFrame([(k, -(-n // GROUP)) for k, n in histogram.items()], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts")).drop("salts")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    ranked = salted.withColumn("nth", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("before"))
    plan = spark.createDataFrame(
        [(s.length, s.rank, s.rank + s.each * s.bins, s.each, s.first_bin, s.offset) for s in packed(histogram, capacity)],
        "s_length long, s_from long, s_to long, s_each long, s_bin long, s_offset long",
    )  # bounded by the histogram, not by the documents
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_from")) & (F.col("rank") < F.col("s_to")))
    return placed.select(
        *cut.columns,
        F.expr("s_bin + (rank - s_from) div s_each").alias("sequence_id"),
        F.expr("s_offset + (rank - s_from) % s_each * length").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every text."""
    return pack(common.written(pieces(docs, vocabulary or default_vocabulary(), capacity), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: see pack_documents."""
    return pack_documents(common.documents(spark, sf_dir))
