import json
import random

from tallymark.llm.queries import QUERIES, SQL
from tallymark.llm.tool_links import chat_calls, json_calls, levels, link

CALLS = "conv_id int, call_id string, position bigint, name string, arguments string, depends array<string>, extra string"
SCHEMAS = [("add", "x", "number", True), ("add", "y", "integer", True), ("add", "note", "string", False), ("now", None, None, None)]


def run(spark, calls, results, schemas=SCHEMAS):
    return {r.call_id: r for r in link(
        spark.createDataFrame([(*c, "z") for c in calls], CALLS), spark.createDataFrame(results, "call_id string, position bigint, content string"),
        spark.createDataFrame(schemas, "name string, field string, type string, required boolean")).collect()}


def test_links_levels_and_schemas(spark):
    calls = [(1, "a", 1, "add", '{"y": 2, "x": 1.5, "note": "é \\"q\\" \\n"}', []), (1, "b", 2, "add", '{"x": 1, "y": "2"}', ["a"]),
             (1, "c", 3, "add", '{"x": 1, "z": {"q":1}}', ["a", "b"]), (1, "d", 4, "now", "{}", ["c", "a"]), (1, "e", 5, "now", "[1]", ["gone"]),
             (2, "f", 1, "none", "{}", ["g"]), (2, "g", 2, "now", "{}", ["f"]), (2, "h", 3, "now", "{}", ["g"]),
             (2, "i", 4, "now", None, None), (2, None, 5, "now", "{}", None), (2, "j", 9, "now", "{}", None), (2, "j", 8, "now", '{"k":null}', None)]
    got = run(spark, calls, [("a", 2, "3.5"), ("a", 1, "first"), ("b", 2, None), ("d", 5, "x"), ("zz", 1, "lost"), (None, 1, "x")])
    assert sorted(got) == list("abcdefghij")
    assert [got[k].level for k in "abcdefghij"] == [0, 1, 2, 3, 0, None, None, None, 0, 0]
    assert got["a"].valid and got["a"].errors == []
    assert got["a"].json == '{"arguments":{"note":"é \\"q\\" \\n","x":1.5,"y":2},"id":"a","level":0,"name":"add","result":"first"}'
    assert got["b"].errors == ["type:y"] and got["c"].errors == ["missing:y", "unknown:z", "no result"]
    assert got["d"].valid and got["e"].errors == ["no object", "no result", "depends:gone"]
    assert got["f"].errors == ["no tool", "no result", "cycle"] and got["h"].errors == ["no result", "cycle"]
    assert got["i"].errors == ["no object", "no result"] and got["j"].errors == ["unknown:k", "no result"]
    for r in got.values():
        assert list(json.loads(r.json)) == ["arguments", "id", "level", "name", "result"]


def test_levels_of_random_graphs(spark):
    rng = random.Random(11)
    for shape in ("forest", "mixed"):
        needs = {}
        for i in range(120):
            k = rng.choice([0, 1, 1, 1, 1]) if shape == "forest" else rng.choice([0, 1, 1, 2, 3])
            needs[i] = set(rng.sample(range(max(0, i - 15), i), min(k, i)))
        needs[50] |= {60}
        needs[60] |= {50}
        want, left = {}, dict(needs)
        while ready := [v for v, n in left.items() if n <= set(want)]:
            for v in ready:
                want[v] = 1 + max((want[n] for n in left.pop(v)), default=-1)
        links = spark.createDataFrame([(f"n{v}", f"n{n}") for v in needs for n in needs[v]], "call_id string, needs string")
        nodes = spark.createDataFrame([(f"n{v}",) for v in needs], "call_id string")
        assert {r.call_id: r.level for r in levels(links, nodes).collect()} == {f"n{v}": x for v, x in want.items()} and len(want) < 120


def test_numbers_results_and_canonical_members(spark):
    calls = [(1, k, 1, "now", a, []) for k, a in (("big", '{"q":[1e400]}'), ("long", '{"q":' + "1" * 41 + "}"), ("text", '{"q":"1e400 \\" 1e400"}'), ("dup", '{"q":1,"q":2}'))]
    got = run(spark, calls, [("text", 1, "")], [("now", "q", "string", False)])
    assert got["big"].errors == got["long"].errors == ["number", "no result"] and json.loads(got["big"].json)["arguments"] is None
    assert got["text"].errors == [] and json.loads(got["text"].json)["result"] == "" and json.loads(got["dup"].json)["result"] is None
    assert got["dup"].errors == ["no object", "no result"]


def test_calls_in_texts(spark):
    talk = [(1, 0, "user", "add 1 and 2"), (1, 1, "assistant", json.dumps({"tool_calls": [
        {"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "function": {"name": "add", "arguments": '{"x": 1, "y": 5}'}, "depends_on": ["a"]}, 7]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"sum": 3}})), (1, 3, "tool", '{"tool_call_id": "b", "content": "6"}'), (1, 4, "tool", "no json"),
        (2, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "now", "arguments": {}}]}'), (2, 1, "assistant", None), (None, 0, "assistant", "{}"), (3, None, None, "[1]")]
    calls, results = json_calls(spark.createDataFrame(talk, "conv_id int, turn int, role string, text string"))
    got = {r.call_id: r for r in link(calls, results, spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")).collect()}
    assert sorted(got) == ["1/a", "1/b", "2/a"] and got["1/a"].valid and got["1/b"].valid and got["1/b"].level == 1
    assert got["1/a"].json == '{"arguments":{"x":1,"y":2},"id":"1/a","level":0,"name":"add","result":"{\\"sum\\":3}"}'
    assert got["2/a"].errors == ["no result"]


def test_odd_turns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (None, 1, "user", "x"), (1, None, "user", "x"), (1, 1, None, "x"), (1, 2, "user", None)]
    calls, results = chat_calls(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert [r.call_id for r in calls.collect()] == ["call-1-2"] and results.count() == 1


def test_long_chain_and_empty(spark):
    n = 1000
    calls = [(1, f"c{i}", i, "now", "{}", [f"c{i - 1}"] if i else []) for i in range(n)]
    got = run(spark, calls, [(f"c{i}", i, "w " * 50_000) for i in range(3)])
    assert [got[f"c{i}"].level for i in range(n)] == list(range(n))
    assert run(spark, [], []) == {}


def test_chat_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rows = con.execute(SQL["op10_tool_links"]).fetchall()
    names = [c[0] for c in con.description]
    got = QUERIES["op10_tool_links"](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, rows))
