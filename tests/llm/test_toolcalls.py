"""Tool-call linking on a small fixture with every kind of fault."""

import json
import random

from dosewise.llm import toolcalls

CALLS = "call_id string, conv_id long, turn long, name string, arguments string"
RESULTS = "call_id string, conv_id long, turn long, content string"
NEEDS = "call_id string, conv_id long, needs_id string"


def run(spark, calls, results=(), needs=(), schemas=(("t", "a", "integer", True, 0.0, 9.0), ("t", "b", "string", False, None, 3.0), ("t", "c", "number", False, None, None))):
    frames = [spark.createDataFrame(list(r), s) for r, s in ((calls, CALLS), (results, RESULTS), (needs, NEEDS), (schemas, toolcalls.TOOL_SCHEMA))]
    return toolcalls.link(*frames).collect()


def by_id(rows):
    return {r.call_id: r for r in rows}


def test_links_validates_and_orders(spark):
    calls = [
        ("1", 1, 5, "t", '{"c": 2, "a": 3}'), ("2", 1, 1, "t", '{"b":"long", "a": 10}'), ("3", 1, 2, "t", '{"a":"x","z":1}'), ("4", 1, 0, "t", "[1]"), ("5", 1, 3, "u", "{}"),
        ("6", 2, 0, "t", '{"b":"x"}'), ("7", 2, 1, "t", '{"a":1}'), ("8", 2, 2, "t", '{"a":1}'),
    ]
    results = [("1", 1, 6, '{"z":1, "y":[2.50, null]}'), ("2", 1, 2, "plain \"text\""), ("9", 1, 1, "lost"), ("7", 2, 2, "a")]
    needs = [("1", 1, "2"), ("1", 1, "3"), ("3", 1, "4"), ("6", 2, "7"), ("7", 2, "6"), ("8", 2, "6"), ("5", 1, "none"), ("2", 1, None), ("1", 1, "2"), ("8", 1, "2")]
    got = by_id(run(spark, calls, results, needs))
    assert len(got) == 9
    problems = {k: r.problems for k, r in got.items()}
    assert problems["1"] == [] and problems["2"] == ["out of range a", "out of range b"]
    assert problems["3"] == ["undeclared z", "wrong type a", "no result"] and problems["4"] == ["arguments are no object", "no result"]
    assert problems["5"] == ["unknown tool", "no result", "unknown need"] and problems["6"] == ["missing a", "no result", "circular needs"]
    assert problems["7"] == ["circular needs"] and problems["8"] == ["no result", "circular needs"]
    assert problems["9"] == ["result without call"] and got["9"].kind == "result" and got["1"].kind == "call"
    assert {k: got[k].level for k in "123456"} == {"1": 2, "2": 0, "3": 1, "4": 0, "5": 0, "6": None}
    assert [k for k in sorted("123459", key=lambda k: got[k].position)] == ["4", "2", "5", "3", "1", "9"]
    assert sorted(got[k].position for k in "678") == [0, 1, 2]
    assert got["1"].canonical == '{"arguments":{"a":3,"c":2},"id":"1","name":"t","needs":["2","3"],"result":{"y":[2.5,null],"z":1}}'
    assert json.loads(got["2"].canonical)["result"] == 'plain "text"' and json.loads(got["7"].canonical)["result"] == "a"


def test_nothing_is_lost(spark):
    """Identifiers that are unique in a conversation only, repeats, missing identifiers, several results."""
    calls = [("c", 1, 0, "t", '{"a":1}'), ("c", 2, 0, "t", '{"a":2}'), (None, 1, 3, "t", '{"a":3}'), (None, 1, 3, "t", '{"a":4}'), ("c", 2, 1, "t", '{"a":5}'), ("c", 2, 1, "t", '{"a":5}'), ("c", None, 0, "t", '{"a":6}')]
    results = [("c", 1, 1, "one"), ("c", 2, 1, "two"), ("c", 2, 2, "more"), ("c", 2, 2, "more"), (None, 2, 1, "nobody"), ("d", 2, 1, "stray"), ("c", None, 1, "null")]
    rows = run(spark, calls, results, [("c", 2, "c2"), ("c", 1, None)])
    own = [r for r in rows if r.kind == "call"]
    assert sorted(json.loads(r.canonical)["arguments"]["a"] for r in own) == [1, 2, 3, 4, 5, 5, 6] and len(rows) == 7 + 4
    answers = {(r.conv_id, json.loads(r.canonical)["arguments"]["a"]): json.loads(r.canonical)["result"] for r in own if r.n_results}
    assert answers == {(1, 1): "one", (2, 2): "two", (None, 6): "null"}
    assert sorted((json.loads(r.canonical)["result"], r.problems[0]) for r in rows if r.kind == "result") == [
        ("more", "further result"), ("more", "further result"), ("nobody", "no identifier"), ("stray", "result without call")]
    shown = {(r.conv_id, json.loads(r.canonical)["arguments"]["a"]): (r.level, r.problems) for r in own}
    assert shown[2, 2] == (0, ["several results", "repeated call", "unknown need"]) and shown[2, 5] == (0, ["repeated call"])
    assert shown[1, 3] == (0, ["no identifier"]) and shown[1, 1] == (0, [])
    for conv in (1, 2, None):
        at = sorted(r.position for r in rows if r.conv_id == conv)
        assert at == list(range(len(at)))


def brute_levels(nodes, needs):
    into = {n: [b for a, b in needs if a == n] for n in nodes}
    level = {}
    while ready := [n for n in nodes if n not in level and all(m in level for m in into[n])]:
        level.update({n: 1 + max((level[m] for m in into[n]), default=-1) for n in ready})
    return level


def test_levels_as_brute_force(spark):
    rng = random.Random(5)
    nodes = [f"n{k}" for k in range(150)]
    needs = {(f"n{k}", f"n{j}") for k in range(1, 120) for j in rng.sample(range(max(0, k - 6), k), min(k, rng.choice([0, 1, 1, 1, 2, 3])))}
    needs |= {(f"n{a}", f"n{b}") for a, b in [(120, 121), (121, 120), (122, 121), (123, 123), (124, 5), (125, 124), (126, 125), (126, 122)]}
    got = toolcalls.levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(sorted(needs), "node string, to string"))
    assert {r.node: r.level for r in got.collect()} == brute_levels(nodes, needs)


def test_a_chain_takes_few_rounds(spark):
    n = 2000
    calls = [(f"c{i}", 1, 0, "t", '{"a":1}') for i in range(n)]
    rows = run(spark, calls, (), [(f"c{i}", 1, f"c{i - 1}") for i in range(1, n)])
    assert {r.call_id: (r.level, r.position) for r in rows} == {f"c{i}": (i, i) for i in range(n)}


def test_crowded_turns(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "CROWDED", 50)
    rows = run(spark, [(f"c{i % 7}", 1, i % 3, "t", '{"a":1}') for i in range(300)] + [("x", 2, 0, "t", "{}")])
    assert sorted(r.position for r in rows if r.conv_id == 1) == list(range(300))
    assert [r.turn for r in sorted(rows, key=lambda r: r.position) if r.conv_id == 1] == sorted(i % 3 for i in range(300))


def test_long_and_wide_conversations(spark):
    n = 3000
    calls = [(f"c{i}", 1, i, "t", '{"a":1}') for i in range(n)]
    needs = [(f"c{i}", 1, f"c{(i - 1) // 2}") for i in range(1, n)]
    got = run(spark, calls, (), needs)
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(n))
    seen = {r.call_id: r.position for r in order}
    assert all(seen[a] > seen[b] for a, _, b in needs)


def test_empty(spark):
    assert run(spark, []) == []
