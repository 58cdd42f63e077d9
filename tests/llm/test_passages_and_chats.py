from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

from braidwork.llm import chat_format, suffix_dedup

from . import fixtures


def planted():
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 60, 120, 400)]
    rows = [(k, " ".join(word() for _ in range(rng.randrange(1, 200)))) for k in range(60)]
    for k in range(100, 160):
        p = passages[k % 5]
        rows.append((k, " ".join([*(word() for _ in range(rng.randrange(0, 80))), *p, *(word() for _ in range(rng.randrange(0, 80)))])))
    short = " ".join(word() for _ in range(49))
    rows += [(200, short), (201, f"x {short} y"), (202, None), (203, ""), (204, "tick tock " * 400), (205, rows[3][1].upper() if len(rows[3][1].split()) >= 50 else "z"), (None, " ".join(passages[2]))]
    return [*rows, rows[70]]


def covered(rows):
    """Words of each document that lie in a run of 50 that occurs twice."""
    at = defaultdict(list)
    for i, t in dict(rows).items():
        w = fixtures.words(t)
        for k in range(len(w) - 49):
            at[tuple(w[k : k + 50])].append((i, k))
    out = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for i, k in places:
                out[i].update(range(k, k + 50))
    return out


def test_passages_equal_brute_force(spark):
    rows = planted()
    got = defaultdict(set)
    first = {}
    for r in suffix_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        assert r.n_words >= 50
        got[r.doc_id].update(range(r.start, r.start + r.n_words))
        first[r.doc_id] = r.is_first
    assert dict(got) == dict(covered(rows))
    assert [first[k] for k in (101, 106, 111)] == [True, False, False]


def test_passages_stay_where_they_are_first(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, place int")
    out = suffix_dedup.dedup_passages(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = {r.doc_id: r.text for r in out.collect()}
    was = dict(rows)
    cov = covered(rows)
    for i in (101, 103, 104):  # the text without an id holds passage 2 first
        assert left[i] == was[i]
    for i in (106, 107, 158):
        assert len(left[i].split()) == len(was[i].split()) - len(cov[i])
    assert left[202] is None and left[200] == was[200]
    assert suffix_dedup.passages(docs.limit(0)).count() == 0


def plain_order(calls):
    """Levels of a conversation's calls by hand."""
    level = {}
    while True:
        new = {c: 1 + max((level[d] for d in needs if d in calls), default=-1) for c, needs in calls.items() if c not in level and all(d in level for d in needs if d in calls)}
        if not new:
            return level
        level |= new


def test_calls_equal_a_plain_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(20):
        ids = [f"c{k}" for k in range(rng.randrange(1, 8))]
        needs = {c: {d for d in ids if rng.random() < 0.25} for c in ids}
        calls = [{"id": c, "name": "f", "arguments": {"x": [{"$ref": d} for d in sorted(needs[c])], "n": 1}} for c in ids]
        rows.append((conv, 0, "assistant", json.dumps({"content": None, "tool_calls": calls})))
        answered = [c for c in ids if rng.random() < 0.7]
        rows += [(conv, k + 1, "tool", json.dumps({"tool_call_id": c, "content": {"b": 1, "a": 2}})) for k, c in enumerate(answered)]
        level = plain_order(needs)
        for c in ids:
            want[conv, c] = (level.get(c), "cycle" if c not in level else "ok" if c in answered else "unanswered")
    out = chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}}).collect()
    got = {(r.conv_id, r.call_id): (None if r.status == "cycle" else r.level, r.status) for r in out if r.kind == "call"}
    assert got == want
    order = {(r.conv_id, r.call_id, r.kind): (r.turn, r.level, r.place, r.part) for r in out if r.call_id}
    assert all(order[i, c, "result"] > order[i, c, "call"] for i, c, k in order if k == "result")
    assert all(r.message == chat_format.canonical(json.loads(r.message)) for r in out)


def test_schema_violations():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}}}}
    assert chat_format.violations({"a": 1, "b": ["x"]}, schema) == []
    assert chat_format.violations({"a": 0, "b": ["y"], "c": 1}, schema) == ["$.a: below 1", "$.b[0]: not among the allowed values", "$.c: not allowed"]
    assert chat_format.violations({"a": True}, schema) == ["$.a: not of type integer"] and chat_format.violations([], schema) == ["$: not of type object"]
    assert chat_format.violations({}, schema) == ["$.a: missing"]


def test_odd_turns(spark):
    call = lambda **x: json.dumps({"tool_calls": [x]})
    rows = [(1, 0, None, None), (None, 0, "user", "hi"), (1, 1, "assistant", call(id="a", name="g", arguments="{bad")), (1, 2, "assistant", call(name="f")), (1, 3, "tool", "{}"), (1, 4, "tool", json.dumps({"tool_call_id": 3})), (2, 0, "assistant", call(id="a", name="f", arguments="{}")), (2, 0, "assistant", call(id="a", name="f", arguments="{}"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    out = chat_format.formatted(df, {"f": {}}).collect()
    assert sorted((r.kind, r.status) for r in out if r.kind != "message") == [("call", "duplicate"), ("call", "invalid"), ("call", "invalid"), ("call", "unanswered"), ("result", "invalid")]
    assert sum(r.kind == "message" for r in out) == 7
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_written_chats_read_in_order(spark, tmp_path):
    rows = [(1, 1, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "c")]
    chat_format.write_chats(chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), str(tmp_path / "out"))
    assert [json.loads(r.value)["content"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b", "c"]


def windows_of(text):
    w = fixtures.words(text)
    return [tuple(w[k : k + 50]) for k in range(len(w) - 49)]


def test_passages_of_edited_copies_equal_brute_force(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(12):
            w[rng.randrange(300)] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    got = defaultdict(set)
    for r in suffix_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        got[r.doc_id].update(range(r.start, r.start + r.n_words))
    assert dict(got) == dict(covered(rows))


def test_one_of_each_repeated_window_is_left(spark):
    rng = random.Random(6)
    p1, p2, p3 = ([f"{x}{k}" for k in range(60)] for x in "pqr")
    base = [f"b{k}" for k in range(300)]
    rows = [(1, p1), (2, p1 + p2), (3, p2), (4, [*p3, "between", *p3])]
    for i in range(10, 60):
        w = list(base)
        for _ in range(8):
            w[rng.randrange(300)] = f"e{rng.randrange(10**9)}"
        rows.append((i, w))
    rows = [(i, " ".join(w)) for i, w in rows]
    out = suffix_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = {r.doc_id: r.text for r in out}
    assert [left[i].split() for i in (1, 2, 3, 4)] == [p1, p2, [], [*p3, "between"]]
    kept = {w for t in left.values() for w in windows_of(t)}
    times = Counter(w for _, t in rows for w in windows_of(t))
    assert {w for w, n in times.items() if n > 1} <= kept


def test_untrusted_json(spark):
    call = lambda a: '{"tool_calls":[{"id":"a\\ud800","name":"f","arguments":' + a + "}]}"
    deep = "[" * 300 + "]" * 300
    texts = [call('{"x":"\\ud800"}'), call(json.dumps(deep)), call('"NaN"'), call('"[1e999]"'), call('{"x":NaN}'), call("[" * 5000 + "]" * 5000), call('"' + "9" * 5000 + '"'), call('{"k\\udfff":1}')]
    out = chat_format.formatted(spark.createDataFrame([(k, 0, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string"), {"f": {"additionalProperties": False, "properties": {"x": {}}}}).collect()
    got = {r.conv_id: (r.status, r.errors) for r in out if r.kind == "call"}
    assert got == {0: ("unanswered", ""), 1: ("invalid", "$: not JSON"), 2: ("invalid", "$: not JSON"), 3: ("invalid", "$: not JSON"), 6: ("invalid", "$: not JSON"), 7: ("invalid", "$.k\\udfff: not allowed")}
    assert {r.conv_id for r in out if r.kind == "message"} == set(range(8))
    assert all(json.loads(r.message) is not None for r in out)


def test_turns_as_calls_equal_sql(spark, tmp_path):
    from .. import conftest

    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "other", None]), rng.choice(["hello", "", None, "ABC", 'q"uote\n', "né"])) for c in range(60) for t in range(rng.randrange(1, 40))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("part-*.parquet")).rename(tmp_path / "conversations.parquet")
    out = chat_format.query(spark, str(tmp_path))
    assert {r.status for r in out.select("status").distinct().collect()} >= {"ok", "orphan", "unanswered", "invalid"}
    conftest.same_rows(out, chat_format.ORACLE, str(tmp_path))
