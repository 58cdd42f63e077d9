"""The five stages against plain versions, each on what its predecessor kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from braidwork.llm import common, packing
from braidwork.llm.common import written

from . import fixtures
from .test_decontamination import brute as contaminated
from .test_line_dedup import brute as repeated
from .test_near_dedup import brute as groups

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = texts(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SMALL), f"test-{k}")
        rows = list(before.items())
        if name == "best-fit packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            enc = packing.encoder(packing.default_vocabulary())
            assert {r.doc_id: r.n for r in docs.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()} == {i: len(enc.ids(t)) + 1 for i, t in rows}
            return
        assert docs.columns == columns
        after = texts(docs)
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "language ID":
            assert after == before
        elif name == "line dedup":
            gone = repeated(rows)
            left = {i: "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}
            assert after == {i: t for i, t in left.items() if fixtures.words(t) or not fixtures.words(before[i])}
        elif name == "MinHash near-dedup":
            assert set(after) == {i for i, c in groups(rows, 80).items() if i == c}
        else:
            known = {s for _, t in items for s in fixtures.shingles(t)}
            near = [(i, t) for i, t in rows if fixtures.shingles(t) & known]
            assert set(after) == set(before) - {d for d, _ in contaminated(near, items)}
        before = after


def test_stages_on_odd_rows(spark):
    rows = [r for r in fixtures.corpus() if r[0] is not None]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SMALL), f"odd-{k}")
    lengths = Counter()
    for r in docs.collect():
        lengths[r.sequence_id] += r.length
    assert lengths and max(lengths.values()) <= packing.CAPACITY


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], fixtures.SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SMALL), f"none-{k}")
    assert docs.count() == 0


def test_the_driver_trims_its_native_memory_before_each_table(spark, monkeypatch):
    said = []
    trim = common.trim_native
    monkeypatch.setattr(common, "trim_native", lambda s: said.append(trim(s)))
    assert common.written(spark.range(3), "trimmed").count() == 3
    assert len(said) == 1 and said[0].startswith("Trim native heap")
