import json
import random

from tallyspark.llm.chat_format import CALLS_SCHEMA, RESULTS_SCHEMA, depths, format_chats, link_tool_calls, schemas

TOOLS = [{"name": "add", "parameters": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}]
OK = '{"a":1,"b":1}'


def linked(spark, calls, results):
    """Calls (conv, turn, id, name, arguments, after) and results (conv, turn, id, role, content) by (id, turn)."""
    c = spark.createDataFrame([(v, t, 0, *r) for v, t, *r in calls], CALLS_SCHEMA)
    r = spark.createDataFrame([(v, t, 0, *r) for v, t, *r in results], RESULTS_SCHEMA)
    return {(x.conv_id, x.call_id, x.turn): x for x in link_tool_calls(c, r, schemas(spark, TOOLS)).collect()}


def test_linking_validation_and_canonical_json(spark):
    calls = [
        (1, 0, "x", "add", '{"b": 2.5, "a": 1}', None), (1, 1, "y", "add", '{"a": "1", "c": null}', ["x"]), (1, 2, "z", "sub", "{}", ["y", "gone"]), (1, 3, "u", "add", "not json", None), (1, 4, "w", "add", "[1]", ["x"]),
        (1, 5, None, "add", '{"a": 1, "b": 1}', None),
    ]
    got = linked(spark, calls, [(1, 9, "x", "tool", 'é "q"\n'), (1, 8, "x", "tool", "first"), (1, 1, "nobody", "tool", "?"), (1, 2, None, "tool", "?")])
    x = got[1, "x", 0]
    assert x.json == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","result":{"content":"first","role":"tool","turn":8},"type":"call"}'
    assert x.linked and x.errors == ["several results"] and x.depth == 0
    assert got[1, "y", 1].errors == ["missing:b", "no result", "type:a", "unexpected:c"] and got[1, "y", 1].depth == 1
    assert got[1, "z", 2].errors == ["no result", "no such tool"] and got[1, "z", 2].depth == 2
    assert got[1, "u", 3].errors == ["no result", "not an object"] and json.loads(got[1, "u", 3].json)["arguments"] == "not json"
    assert got[1, "w", 4].errors == ["no result", "not an object"]
    assert "no id" in got[1, None, 5].errors
    assert got[1, "nobody", 1].errors == got[1, None, 2].errors == ["no such call"] and len(got) == 8
    for r in got.values():
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_identifiers_hold_within_their_conversation(spark):
    calls = [(1, 0, "call_1", "add", OK, None), (2, 0, "call_1", "add", OK, None), (3, 0, "call_1", "add", OK, ["call_2"]), (None, 0, "call_1", "add", OK, None)]
    got = linked(spark, calls, [(1, 1, "call_1", "tool", "one"), (2, 1, "call_1", "tool", "two"), (4, 1, "call_1", "tool", "stray"), (None, 1, "call_1", "tool", "null")])
    content = {k: json.loads(r.json).get("result", {}).get("content") for k, r in got.items()}
    assert content == {(1, "call_1", 0): "one", (2, "call_1", 0): "two", (3, "call_1", 0): None, (4, "call_1", 1): None, (None, "call_1", 0): "null"}
    assert got[1, "call_1", 0].errors == got[2, "call_1", 0].errors == [] and got[3, "call_1", 0].errors == ["no result"] and got[4, "call_1", 1].errors == ["no such call"]


def test_a_result_follows_its_call(spark):
    got = linked(spark, [(1, 5, "x", "add", OK, None), (1, 6, "y", "add", OK, None)], [(1, 4, "x", "tool", "before"), (1, 5, "y", "tool", "before"), (1, 8, "y", "tool", "after")])
    assert got[1, "x", 5].errors == ["no result", "result before call"] and not got[1, "x", 5].linked
    assert got[1, "y", 6].errors == ["result before call"] and json.loads(got[1, "y", 6].json)["result"]["content"] == "after"


def longest(after):
    """The longest way of each call, by the definition; None in or behind a cycle."""
    def way(k, seen):
        if k in seen:
            return None
        ways = [way(b, seen | {k}) for b in set(after[k] or []) if b in after]
        return None if None in ways else max([w + 1 for w in ways], default=0)

    return {k: way(k, frozenset()) for k in after}


def test_topological_order(spark):
    def depth(after):
        table = spark.createDataFrame([(1, 0, 0, k, "add", "{}", v) for k, v in after.items()], CALLS_SCHEMA)
        rows = [(r.k.id, r.depth) for r in depths(table).collect()]
        assert len(dict(rows)) == len(rows)
        return dict(rows)

    small = {"a": None, "b": ["a"], "c": ["a", "b"], "d": ["c", "a"], "e": [], "p": ["q"], "q": ["p"], "r": ["p", "a"], "s": ["s"], "t": ["r"], "u": ["d", "gone"], "v": ["s"], "w": ["v", "t"]}
    assert depth(small) == longest(small)
    r = random.Random(3)
    mixed = {f"n{i}": r.sample([f"n{j}" for j in range(max(0, i - 9), i)], min(i, r.choice([0, 1, 1, 1, 2]))) for i in range(60)}
    assert depth(mixed) == longest(mixed)


def test_a_long_chain_takes_few_rounds(spark):
    table = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "0 AS part", "concat('c', id) AS call_id", "'add' AS name", "'{}' AS arguments", "if(id > 0, array(concat('c', id - 1)), null) AS after")
    got = {r.k.id: r.depth for r in depths(table).collect()}
    assert got == {f"c{i}": i for i in range(3000)}


def test_repeated_ids_make_no_pairs(spark):
    got = linked(spark, [(1, i, "x", "add", OK, None) for i in range(5)], [(1, i, "x", "tool", "r") for i in range(1, 8)])
    assert len(got) == 5 and all(r.errors == ["repeated id", "several results"] for r in got.values())


def test_chats(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'say "hi"'), (1, 2, "assistant", "hi"), (1, 3, "user", None), (2, 0, "user", "x\ny" * 300), (2, 5, "assistant", "late"), (None, 0, "user", "y" * 40), (3, 0, None, "z"), (3, None, "user", "q")]
    rows.append((4, 1, "assistant", '<tool_result id="k">early</tool_result><tool_call>{"id":"k","name":"answer","arguments":{"prompt":"p","n_chars":1},"after":["j"]}</tool_call><tool_result id="k">same turn</tool_result>'))
    rows.append((4, 0, "assistant", '<tool_call>{"id":"j","name":"answer","arguments":{"prompt":"' + "long " * 50_000 + '","n_chars":1}}</tool_call>'))
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, call_id string")
    got = {(r.conv_id, r.call_id): r for r in format_chats(df).collect()}
    assert got[1, "call_1"].json == '{"arguments":{"prompt":"say \\"hi\\""},"id":"call_1","name":"answer","result":{"content":"hi","role":"assistant","turn":2},"type":"call"}'
    assert got[1, "call_1"].errors == ["missing:n_chars"] and got[1, "call_3"].errors == ["missing:n_chars", "no result"] and got[1, "call_3"].depth == 1
    assert got[2, "call_0"].errors == ["no result", "type:prompt", "unexpected:long"] and got[2, "call_4"].errors == ["no such call"]
    assert got[None, "call_0"].errors == ["no result"] and got[3, None].errors == ["missing:n_chars", "no id", "no result"]
    k = got[4, "k"]
    assert k.linked and k.depth == 1 and k.errors == ["result before call"] and json.loads(k.json)["result"]["content"] == "same turn"
    assert got[4, "j"].errors == ["no result"] and len(json.loads(got[4, "j"].json)["arguments"]["prompt"]) == 250_000
    assert {x for x, _ in got} == {1, 2, 3, 4, None}
    assert format_chats(df.limit(0)).count() == 0
    twice = [r.errors for r in format_chats(df.where("conv_id = 1").union(df.where("conv_id = 1"))).collect()]
    assert len(twice) == 4 and all("repeated id" in e for e in twice)
