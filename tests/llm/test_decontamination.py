from __future__ import annotations

import random
from collections import Counter

from . import fixtures
from pyspark.sql import functions as F

from braidwork.llm import decontamination


def multiset(w: list[bytes]) -> Counter:
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs: list[tuple], items: list[tuple]) -> dict:
    """The best similarity of each pair over all windows of an item's size."""
    out = {}
    for d, t, *_ in docs:
        w = fixtures.words(t)
        for i, it in items:
            v = fixtures.words(it)
            if not w or not v:
                continue
            want, best = multiset(v), 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                have = multiset(w[s : s + len(v)])
                best = max(best, sum((have & want).values()) / sum((have | want).values()))
            if best >= 0.8:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def case(spark):
    item = " ".join(f"q{k}" for k in range(40))
    edge = " ".join([f"x{k}" for k in range(3)] + item.split()[3:])
    docs = [
        (1, "before " * 30 + item.upper() + " after" * 30), (2, "a b c " + edge + " d e"), (3, "nothing of the kind in here at all"), (4, None), (5, ""), (6, item), (7, " ".join(item.split()[:37])),
        (8, " ".join(item.split()[:20])), (9, "tiny item"), (9, "tiny item"), (10, "is a tiny item here"), (None, item), (11, " ".join(w if k % 4 else f"z{k}" for k, w in enumerate(item.split()))),
    ]
    items = [(100, item), (101, "tiny item"), (102, None), (103, ""), (104, "the the the the the the the the")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, items, d, b = case(spark)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.matches(d, b).collect()}
    assert got == {k: round(v, 9) for k, v in brute(docs, items).items()}


def test_joins_without_broadcast(spark, monkeypatch):
    docs, items, d, b = case(spark)
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(d, b).collect()} == set(brute(docs, items))


def test_clean_documents_stay(spark):
    docs, items, d, b = case(spark)
    d = d.withColumn("start", F.lit(1)).withColumn("n", F.lit(2)).withColumn("words", F.lit("w"))
    kept = decontamination.decontaminate(d, b)
    gone = {k for k, _ in brute(docs, items)}
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in gone)


def test_empty_tables(spark):
    docs, items, d, b = case(spark)
    assert decontamination.matches(d.limit(0), b).count() == 0
    assert decontamination.matches(d, b.limit(0)).count() == 0
    assert decontamination.decontaminate(d, b.limit(0)).count() == len(docs)


def test_no_python_in_plan(spark):
    plan = decontamination.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_that_share_an_id_are_looked_at_one_by_one(spark):
    item = " ".join(f"q{k}" for k in range(40))
    near = " ".join(w if k % 4 else f"z{k}" for k, w in enumerate(item.split()[5:])) + " " + " ".join(item.split()[:5])
    rows = [(None, "clean words alone"), (None, item), *((None, f"{near} {k}") for k in range(30)), (2, "other clean words"), (2, f"{item} tail")]
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), b).collect()
    assert sorted(r.text for r in kept) == sorted(t for _, t in rows if item not in t)


def test_changed_tails_at_the_threshold(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    docs, items = [], []
    for k in range(600):
        n = rng.randrange(15, 60)
        item = [word() for _ in range(n)]
        c = (n - 4) // 9  # as many words as can be changed at the end at a similarity of 0.8
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([word(), word(), *item[: n - c], *(word() for _ in range(c)), word()])))
    got = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_own(docs, items)
    assert len(want) > 500 and {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want


def brute_own(docs, items):
    """brute, of each document with its own item only."""
    return {k: round(v, 9) for d, i in zip(docs, items, strict=True) for k, v in brute([d], [i]).items()}


def test_a_very_long_item_and_items_that_share_an_id(spark):
    long = " ".join(f"w{k}" for k in range(70_000))
    docs = [(1, f"head {long} tail"), (2, " ".join(long.split()[:60_000])), (3, " ".join(f"w{k}" for k in range(100))), (4, "one two three four five six seven"), (5, "eight nine ten eleven twelve thirteen")]
    items = [(1, long), (7, "one two three four five six seven"), (7, "eight nine ten eleven twelve thirteen"), (None, "eight nine ten eleven twelve")]
    got = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (4, 7), (5, 7), (5, None)}
