from __future__ import annotations

import itertools
import random
import zlib
from array import array
from collections import Counter

from . import fixtures
from tokenizers import Tokenizer

from braidwork.llm import packing


def optimum(sizes: list[int], capacity: int) -> int:
    best = [len(sizes)]

    def go(k: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for at in {b: i for i, b in enumerate(bins)}.values():
            if bins[at] + sizes[k] <= capacity:
                bins[at] += sizes[k]
                go(k + 1, bins)
                bins[at] -= sizes[k]
        go(k + 1, [*bins, sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_loses_no_optimum():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(0, 9))]
        fixed, left = packing.reduced(Counter(sizes), capacity)
        rest = list(itertools.chain.from_iterable([s] * n for s, n in left.items()))
        assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(sizes, capacity)


def test_segments_hold_every_piece_once():
    rng = random.Random(4)
    counts = {k: rng.randrange(1, 10**9) for k in range(1, 2049)}
    ranks, bins = Counter(), 0
    for s in packing.packed(counts):
        assert s.rank == ranks[s.length] and s.offset + s.each * s.length <= packing.CAPACITY
        ranks[s.length] += s.each * s.bins
        bins = max(bins, s.first_bin + s.bins)
    assert ranks == Counter(counts)
    volume, large = sum(k * n for k, n in counts.items()) / packing.CAPACITY, sum(n for k, n in counts.items() if k > packing.CAPACITY // 2)
    assert bins <= 1.05 * max(volume, large) + 1


def test_fast_encoder_is_the_slow_one():
    enc = packing.encoder(packing.default_vocabulary())
    assert enc.fast is not None
    for c in range(0x250):
        for t in ("a" + chr(c) + "b", f" {chr(c)} {chr(c)}", chr(c) * 3 + "\n", "x  " + chr(c) + "  1"):
            if packing.SETTLED.fullmatch(t):
                assert list(enc.fast.encode_ordinary(t)) == enc.slow.encode(t, add_special_tokens=False).ids


def test_round_trip(spark):
    rows = fixtures.corpus()
    rows += [(7000, "日本語 text here <|endoftext|>", None, None, None), (7001, "word " * 9000, None, None, None), (7002, "hello <|endoftext|> x", None, None, None), (7003, "<|endoftext|>", None, None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()
    tok = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        starts = [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in got) // 2048)


def test_added_tokens_are_read_as_tokenizers_reads_them():
    enc = packing.encoder(packing.default_vocabulary())
    tok = Tokenizer.from_file(packing.default_vocabulary())
    for text in ("hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext"):
        assert list(enc.ids(text)) == tok.encode(text, add_special_tokens=False).ids


def test_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    rows = [(k, "one two", None, None, None) for k in range(200)]
    got = packing.pack_documents(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()
    assert len(got) == 200 and len({(r.sequence_id, r.offset) for r in got}) == 200


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], fixtures.SCHEMA)).count() == 0
