"""Tool calls: linking, order, validation and canonical lines."""

from __future__ import annotations

import json

from glimmer.llm.toolcalls import TOOLS, format_chats, parse, problem

SCHEMA = "conv_id long, turn long, role string, text string"


def call(*calls, content="c"):
    return json.dumps({"content": content, "tool_calls": [dict(zip(("id", "name", "arguments"), c, strict=True)) for c in calls]})


def result(i, content="r"):
    return json.dumps({"content": content, "tool_call_id": i})


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("text", "role", "turn", "conv_id", "1 as json", "2 as depth")
    return format_chats(df, TOOLS).collect()


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", result("a")),  # stands before its call
        (1, 2, "assistant", call(("a", "search", {"query": "x"}), ("b", "search", {"query": {"$ref": "c"}}))),
        (1, 3, "tool", result("b")),
        (1, 4, "assistant", call(("c", "calculator", '{"expression": "1+1"}'))),
        (1, 5, "tool", result("c")),
        (1, 6, "tool", result("nobody")),
        (1, 7, "tool", result("c", "again")),
        (2, 0, "assistant", call(("a", "search", {"limit": 1}))),
        (2, 1, "tool", result("a")),
    ]
    out = run(spark, rows)
    order = [(r.conv_id, r.turn) for r in out]
    # turn 2 refers to the result of c (turn 5): it moves behind it, then its own results
    assert order == [(1, 0), (1, 4), (1, 5), (1, 2), (1, 1), (1, 3), (1, 6), (1, 7), (2, 0), (2, 1)] or order == [(1, 0), (1, 4), (1, 5), (1, 2), (1, 3), (1, 1), (1, 6), (1, 7), (2, 0), (2, 1)]
    by = {(r.conv_id, r.turn): r for r in out}
    assert (by[1, 2].n_calls, by[1, 2].n_linked, by[1, 2].n_invalid) == (2, 2, 1)  # a reference is no string
    assert by[1, 5].linked and not by[1, 6].linked and not by[1, 7].linked
    assert by[2, 0].n_invalid == 1 and by[2, 1].linked
    assert by[1, 4].json == '{"content":"c","role":"assistant","tool_calls":[{"arguments":{"expression":"1+1"},"id":"c","name":"calculator"}]}'


def test_cycle_keeps_its_turns(spark):
    rows = [(1, 0, "assistant", call(("a", "search", {"query": {"$ref": "b"}}))), (1, 1, "tool", result("a")), (1, 2, "assistant", call(("b", "search", {"query": {"$ref": "a"}}))), (1, 3, "tool", result("b"))]
    assert [r.turn for r in run(spark, rows)] == [0, 1, 2, 3]


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, "tool", result("x")), (2, 0, "assistant", "{not json"), (2, 1, "assistant", '{"tool_calls": [1]}'), (2, 2, "tool", '{"content": NaN, "tool_call_id": "x"}'), (2, 3, "assistant", '{"a": "\\ud800"}'), (2, 4, "user", "x" * 200_000), (2, 5, "assistant", "[" * 5000), (2, 6, "user", "é \" \n")]
    out = run(spark, rows)
    assert len(out) == len(rows) and all(r.n_calls == 0 for r in out)
    assert all(canonical == json.dumps(json.loads(canonical), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for canonical in (r.json for r in out))
    assert format_chats(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = df.collect()
    want = sorted(((r.conv_id, r.turn, parse(r.role, r.text, TOOLS)["json"]) for r in rows), key=str)
    out = format_chats(df, TOOLS).collect()
    assert sorted(((r.conv_id, r.turn, r.json) for r in out), key=str) == want
    assert [(r.conv_id, r.turn) for r in out] == sorted((r.conv_id, r.turn) for r in rows)


def test_schemas():
    s = {"type": "object", "properties": {"n": {"type": "integer"}, "k": {"enum": ["a"]}, "l": {"type": "array", "items": {"type": "number"}}}, "required": ["n"], "additionalProperties": False}
    assert problem({"n": 1, "k": "a", "l": [1, 2.5]}, s) is None
    assert problem({}, s) == "$.n: missing"
    assert problem({"n": True}, s) == "$.n: not integer"
    assert problem({"n": 1, "k": "b"}, s) == "$.k: not among the values"
    assert problem({"n": 1, "l": [1, "x"]}, s) == "$.l[1]: not number"
    assert problem({"n": 1, "z": 0}, s) == "$.z: unknown"
    assert problem([], s) == "$: not object"


def test_deep_arguments(spark):
    def text(depth, quoted):
        arguments = '{"query":' + "[" * depth + "]" * depth + "}"
        return '{"content":"c","tool_calls":[{"arguments":' + (json.dumps(arguments) if quoted else arguments) + ',"id":"a","name":"search"}]}'

    depths = [1, 300, 900, 990, 1000, 2000, 9000, 50_000, 500_000]
    rows = [(1, 2 * i + q, "assistant", text(d, bool(q))) for i, d in enumerate(depths) for q in (0, 1)]
    out = {r.turn: r for r in run(spark, rows)}
    assert len(out) == len(rows)
    assert out[0].n_calls == 1 and out[0].n_invalid == 1 and out[len(rows) - 1].n_invalid == 1
    for turn, _, _, t in ((r[1], r[0], r[2], r[3]) for r in rows):
        r = out[turn]
        # what is too deep to read is plain content, or text among the arguments
        assert r.n_calls == 1 or json.loads(r.json) == {"content": t, "role": "assistant"}


def brute(rows):
    """(conv_id, turn) -> (at_turn, depth, n_linked, linked), message by message."""
    calls, results, refs = {}, {}, []
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        try:
            value = json.loads(text)
        except (ValueError, TypeError):
            continue
        if role == "tool" and isinstance(value, dict) and "tool_call_id" in value:
            results.setdefault((c, value["tool_call_id"]), t)
        if role == "assistant" and isinstance(value, dict):
            for call_ in value.get("tool_calls", []):
                calls.setdefault((c, call_["id"]), t)
                arguments = call_["arguments"]
                refs += [(c, t, v["$ref"]) for v in arguments.values() if isinstance(v, dict)]
    linked = {k: (t, results[k]) for k, t in calls.items() if k in results}
    before: dict = {}
    for (c, _), (a, b) in linked.items():
        before.setdefault((c, b), set()).add(a)
    for c, t, i in refs:
        if (c, i) in linked:
            before.setdefault((c, t), set()).add(linked[c, i][1])
    before = {k: v - {k[1]} for k, v in before.items()}
    place: dict = {}
    nodes = {(c, t) for c, t, _, _ in rows}
    while True:
        ready = [k for k in nodes if k not in place and all((k[0], b) in place for b in before.get(k, ()))]
        if not ready:
            break
        for c, t in ready:
            last = max(((place[c, b]) for b in before.get((c, t), ())), default=(-1, 0))
            place[c, t] = (last[0], last[1] + 1) if last[0] >= t else (t, 0)
    answered = {(c, b) for (c, _), (_, b) in linked.items()}
    counts: dict = {}
    for (c, _), (a, _) in linked.items():
        counts[c, a] = counts.get((c, a), 0) + 1
    return {k: (*place.get(k, (k[1], 0)), counts.get(k, 0), k in answered) for k in nodes}


def test_against_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = []
    for c in range(12):
        n = rng.choice([3, 10, 40])
        for t in range(n):
            if rng.random() < 0.5:
                some = {f"k{j}": {"$ref": f"c{rng.randrange(n)}"} for j in range(rng.choice([0, 0, 1, 1, 2]))}
                rows.append((c, t, "assistant", call((f"c{t}", "search", some | {"query": "q"}))))
            else:
                rows.append((c, t, "tool", result(f"c{rng.randrange(n)}")))
    got = {(r.conv_id, r.turn): (r.at_turn, r.depth, r.n_linked, bool(r.linked)) for r in run(spark, rows)}
    assert got == brute(rows)


def test_long_chain(spark):
    # each call needs the result of the next one, so the whole conversation turns about
    n = 600
    rows = []
    for t in range(0, 2 * n, 2):
        rows.append((1, t, "assistant", call((f"c{t}", "search", {"query": {"$ref": f"c{t + 2}"}}))))
        rows.append((1, t + 1, "tool", result(f"c{t}")))
    out = run(spark, rows)
    assert [r.turn for r in out] == [t + k for t in range(2 * n - 2, -1, -2) for k in (0, 1)]
    assert {(r.conv_id, r.turn): (r.at_turn, r.depth, r.n_linked, bool(r.linked)) for r in out} == brute(rows)


def forks(n):
    """``n`` calls, each of which refers to the results of the next two."""
    rows = []
    for k in range(n):
        t = 2 * k
        rows.append((1, t, "assistant", call((f"c{t}", "search", {"query": {"$ref": f"c{t + 2}"}, "limit": {"$ref": f"c{t + 4}"}}))))
        rows.append((1, t + 1, "tool", result(f"c{t}")))
    return rows


def test_chain_of_forks(spark):
    rows = forks(1000)
    out = run(spark, rows)
    assert {(r.conv_id, r.turn): (r.at_turn, r.depth, r.n_linked, bool(r.linked)) for r in out} == brute(rows)


def test_long_conversations_by_rounds(spark, monkeypatch):
    # four links are many here: one conversation goes through rounds, others don't; one is a cycle
    from glimmer.llm import toolcalls

    monkeypatch.setattr(toolcalls, "WHOLE", 4)
    rows = forks(4)
    rows += [(2, 0, "assistant", call(("a", "search", {"query": {"$ref": "b"}}))), (2, 1, "tool", result("a"))]
    rows += [(2, 2, "assistant", call(("b", "search", {"query": "q"}))), (2, 3, "tool", result("b"))]
    rows += [(3, 0, "tool", result("a")), (3, 1, "assistant", call(("a", "search", {"query": {"$ref": "b"}}))), (3, 2, "assistant", call(("b", "search", {"query": {"$ref": "a"}}))), (3, 3, "tool", result("b"))]
    out = run(spark, rows)
    assert {(r.conv_id, r.turn): (r.at_turn, r.depth, r.n_linked, bool(r.linked)) for r in out} == brute(rows)


def test_query_sql(spark):
    import duckdb

    from glimmer.llm.queries import LLM_ORACLES, op8_toolcalls

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cursor = con.execute(LLM_ORACLES["op8_toolcalls"])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    out = op8_toolcalls(spark, sf)
    got = out.select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert sum(r.n_linked for r in got) > 100 and sum(r.n_invalid for r in got) > 50 and sum(r.at_turn != r.turn for r in got) > 50
