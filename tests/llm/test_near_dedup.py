from __future__ import annotations

from . import fixtures
import pytest

from braidwork.llm import near_dedup


def brute(rows: list[tuple], percent: int) -> dict:
    """The smallest id reachable from each id."""
    docs = [(fixtures.order(i), fixtures.shingles(t)) for i, t, *_ in rows]
    to = {i: i for i, _ in docs}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for k, (a, s) in enumerate(docs):
        for b, z in docs[:k]:
            if s and z and 100 * len(s & z) >= percent * len(s | z):
                x, y = root(a), root(b)
                to[max(x, y)] = min(x, y)
    return {i: root(i) for i in to}


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_brute_force(spark, percent):
    rows = fixtures.corpus()
    got = near_dedup.grouped(spark.createDataFrame(rows, fixtures.SCHEMA), percent).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = {(fixtures.order(i), len(fixtures.shingles(t))) for i, t, *_ in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def test_one_of_each_group_stays(spark):
    rows = fixtures.corpus()
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    want = brute(rows, 80)
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert {fixtures.order(r.doc_id) for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_large_group_of_copies_and_a_chain(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base), None, None, None) for k in range(300)]
    for k in range(30):  # each differs from the next by one word, from the far ones by too many
        base = [*base[:k * 6], f"c{k}", *base[k * 6 + 1 :]]
        rows.append((1000 + k, " ".join(base), None, None, None))
    got = near_dedup.grouped(spark.createDataFrame(rows, fixtures.SCHEMA), 85).collect()
    assert {r.component_id for r in got} == {0}


def test_empty_table(spark):
    assert near_dedup.grouped(spark.createDataFrame([], fixtures.SCHEMA), 85).count() == 0


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    text = lambda x: " ".join(f"{x}{k}" for k in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (3, text("c")), (3, text("d")), (4, text("d"))]
    kept = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text.split()[0] for r in kept) == ["a0", "b0", "c0", "d0"] and {r.doc_id for r in kept} == {None, 3}
