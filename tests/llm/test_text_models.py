"""Operators that learn or hash: held-out accuracy, exact parts against plain versions, odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from braidwork.llm import fingerprints, language_id, lm_scoring, toxicity

from . import fixtures

SMALL = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.query(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(out) > 100
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_odd_texts(spark):
    model = language_id.fit(spark.createDataFrame([(k, "the cat sat on the mat and was happy", "en") for k in range(40)] + [(100 + k, "der hund lief durch den wald und war froh", "de") for k in range(40)] + [(200, "x", None)], "doc_id long, text string, lang string"))
    texts = [None, "", "12 %% !", "the cat", "der hund", "日本語の文章", "cat " * 200_000]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in range(3)] == ["und"] * 3 and all(got[k].rejected and got[k].score == 0 for k in range(3))
    assert (got[3].lang_pred, got[4].lang_pred, got[6].lang_pred) == ("en", "de", "en") and got[5].rejected
    assert language_id.filter_known(docs, model).columns == docs.columns
    none = language_id.fit(docs.limit(0).selectExpr("doc_id", "text", "score as lang"))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_kneser_ney_is_a_distribution():
    import numpy as np

    text = "abracadabra alakazam " * 3
    view = np.lib.stride_tricks.sliding_window_view(language_id.letters(text), language_id.ORDER)
    _, first, n = np.unique(language_id._hash_rows(view), return_index=True, return_counts=True)
    alphabet = sorted({*view.ravel().tolist()})
    m = language_id.KneserNey.fit(view[first], n, len(alphabet) + 1)
    for hist in (view[0][:-1], view[7][:-1], np.array([1, 2, 3, 4])):
        grams = np.array([[*hist, c] for c in [*alphabet, 0x10FFFF]], np.uint32)
        assert m.probability(grams).sum() == pytest.approx(1, abs=1e-9)


def toxic_case(spark):
    rng = random.Random(6)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(600):
        w = [rng.choice(plain) for _ in range(120)]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(120)] = rng.choice(["vile", "rotten", "nasty"])
        for i in range(9, 120, 10):
            w[i] += "."
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_held_out_and_located(spark):
    rows, labels = toxic_case(spark)
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "%% 1"), rows[0]], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).collect()
    truth = dict(labels)
    out = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= toxicity.THRESHOLD) == bool(truth[r.doc_id]) for r in out) >= 0.97 * len(out)
    assert [r.score for r in got if r.doc_id >= 9000] == [0.0] * 3 and len(got) == len(rows) + 4
    text = dict(rows)
    found = [text[r.doc_id][s.start : s.end] for r in out for s in r.offending]
    assert found and all(any(b in s for b in ("vile", "rotten", "nasty")) for s in found)
    none = toxicity.fit(docs, marks.limit(0))
    assert {r.score < 0.01 for r in toxicity.score(docs, none).collect()} == {True}


def test_fingerprints_of_edits(spark):
    rows = [r for r in fixtures.corpus() if r[0] is not None]
    rows = list(fixtures.distinct_ids(rows).items())
    got = {r.doc_id: r for r in fingerprints.edited_by_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
        for likeness, other in ((got[i].near_edited, e), (got[i].near_next, after)):
            a, b = fixtures.shingles(t), fixtures.shingles(other)
            errors.append(abs(likeness - (len(a & b) / len(a | b) if a | b else 1)))
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.25
    by_text: dict = {}
    for i, t in rows:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert fingerprints.edited_by_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.edited_by_next(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


def test_similar_pairs_equal_brute_force(spark):
    rows = [r for r in fixtures.corpus() if r[0] is not None and r[1] is not None]
    ids: dict = {}
    for i, t, *_ in rows:
        ids[t] = min(i, ids.get(t, i))
    docs = [(i, fixtures.shingles(t)) for t, i in ids.items()]
    want = {(min(a, b), max(a, b)) for k, (a, s) in enumerate(docs) for b, z in docs[:k] if s and z and 5 * len(s & z) >= 4 * len(s | z)}
    got = {(r.a, r.b) for r in fingerprints.similar(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()}
    assert got == want


def test_lm_counts_are_exact(spark):
    rows = fixtures.corpus()
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    got = lm_scoring.score(docs, *lm_scoring.fit(docs.where(~lm_scoring.held_out()))).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not held(i) for w in [*fixtures.words(t), b""])
    n, v = sum(c.values()), len(c)
    line = lambda t: (len(fixtures.words(t)) + 1, sum(c[w] > 0 for w in [*fixtures.words(t), b""]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*fixtures.words(t), b""]), 6))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == Counter((i, *line(t)) for i, t, *_ in rows)
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)


def test_lm_classes_are_a_distribution():
    import numpy as np

    counts = np.array([50, 40, 30, 3, 2, 1] + [1] * 60, np.float64)
    v = lm_scoring.Vocabulary.of(np.arange(len(counts)), counts, int(counts.sum()) + 100, len(counts) + 20)
    logs = lm_scoring._class_logs(np.zeros((lm_scoring.ROWS, lm_scoring.CLASSES), np.float32), v.priors, [np.zeros(1, np.int32)] * 3)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
    for k in range(lm_scoring.CLASSES - 1):
        if (v.classes == k).any():
            assert (10 ** v.log_in_class[:-1][v.classes == k]).sum() == pytest.approx(1)


def test_lm_parts_are_a_distribution():
    import numpy as np

    counts = np.array([50, 40, 30] * 9 + list(range(1, 400)), np.float64)
    v = lm_scoring.Vocabulary.of(np.arange(len(counts)), counts, int(counts.sum()) + 100, len(counts) + 20)
    w = np.random.default_rng(5).normal(size=(lm_scoring.ALL_ROWS, lm_scoring.CLASSES)).astype(np.float32)
    history = lm_scoring._history(np.array([7, 8, 9]), np.array([0]))
    past = [x[2:] for x in history]
    logs = lm_scoring._class_logs(w, v.priors, lm_scoring._rows(past, lm_scoring.BUCKETS, 0))[0]
    total = np.exp(logs[-1])
    for k in range(lm_scoring.CLASSES - 1):
        own = v.classes == k
        p = 10 ** v.log_in_class[:-1][own]
        if k >= lm_scoring.SINGLES:
            band = np.array([k - lm_scoring.SINGLES])
            parts = lm_scoring._class_logs(w, v.part_priors[band], lm_scoring._part_rows(past, band))[0]
            p = p * np.exp(parts - v.part_priors[band[0]])[v.parts[own]]
            assert set(v.parts[own]) <= set(range(lm_scoring.PARTS))
        total += np.exp(logs[k]) * p.sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_learns_what_follows_uncommon_words(spark):
    """Words that no class has to itself: what follows them is learned by their part."""
    rng = random.Random(3)
    rows = []
    for k in range(400):
        w, out = rng.randrange(60), []
        for _ in range(150):
            out.append(f"w{w}")
            w = (w * 7 + 1) % 60 if rng.random() < 0.95 else rng.randrange(60)
        rows.append((k, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lm_scoring.score(docs, *lm_scoring.fit(docs.where(~lm_scoring.held_out()))).collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_lm_scores_hardly_depend_on_tasks(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    per_word = []
    for tasks in (2, 9):
        own = docs.repartition(tasks, "doc_id")
        got = [r for r in lm_scoring.score(own, *lm_scoring.fit(own.where(~lm_scoring.held_out()))).collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
        per_word.append(sum(r.score for r in got) / sum(r.n_tokens for r in got))
        assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert per_word[0] == pytest.approx(per_word[1], rel=0.02)


def test_lm_learns_order(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):  # the next word follows from the last
        w, out = rng.randrange(8), []
        for _ in range(120):
            out.append(f"w{w}")
            w = (w * 3 + 1) % 8 if rng.random() < 0.95 else rng.randrange(8)
        rows.append((k, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lm_scoring.score(docs, *lm_scoring.fit(docs.where(~lm_scoring.held_out()))).collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_lm_without_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm_scoring.score(docs, *lm_scoring.fit(docs.limit(0))).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}


def test_language_models_learn_from_the_whole_sample():
    assert language_id.SAMPLE_PER_LANGUAGE >= 1000
