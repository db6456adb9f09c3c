import json
import random

from palaver.llm import toolcalls

SCHEMAS = toolcalls.SCHEMAS | {"add": {"a": ("number", True), "b's": ("integer", False)}}


def call(**x):
    return f"so <tool_call>{json.dumps(x)}</tool_call> then"


def rows(spark, messages):
    m = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    return {r.call_id: r for r in toolcalls.link(toolcalls.chat_calls(m), toolcalls.chat_results(m), SCHEMAS).collect()}


def test_marked_calls(spark):
    r = rows(spark, [
        (1, 0, "assistant", call(id="x", name="add", arguments={"b's": 2, "a": 1.50}, refs=["y"])),
        (1, 1, "tool", '<tool_result>{"id": "x", "content": {"z": 1, "a": [2, "é\\"/"]}}</tool_result>'),
        (1, 2, "assistant", call(id="y", name="add", arguments={"a": "1", "c": 0})),
        (1, 3, "assistant", call(id="p", name="add", arguments={}, refs=["q"])), (1, 3, "assistant", call(id="q", name="none", arguments={"a": 1}, refs=["p"])),
        (1, 4, "assistant", call(id="r", name="add", arguments=[1], refs=["p"])),
        (2, 0, "assistant", call(id="x", name="add", arguments={"a": 1})), (2, 0, "assistant", call(id="x", name="add", arguments={"a": 1})),
        (2, 1, "tool", '<tool_result>{"id": "x", "content": 1}</tool_result><tool_result>{"id": "x", "content": 2}</tool_result>'), (2, 2, "tool", '<tool_result>{"id": "lost", "content": 2}</tool_result>'),
    ])
    marked = {k: v for k, v in r.items() if not k.split(":")[1].lstrip("-").isdigit()}
    assert {k: (v.status, v.topo_level, v.errors) for k, v in marked.items()} == {
        "1:x": ("linked", 1, ""), "1:y": ("no_result", 0, "type:a,unknown:c"), "1:p": ("cycle", None, "missing:a"), "1:q": ("cycle", None, "unknown tool"), "1:r": ("cycle", None, "not an object"),
        "2:x": ("linked", 0, ""), "2:lost": ("orphan", None, ""),
    }
    assert r["1:x"].json == '{"arguments":{"a":1.5,"b\'s":2},"id":"1:x","name":"add","result":{"a":[2,"é\\"/"],"z":1}}'
    assert r["2:x"].n_results == 2 and json.loads(r["2:x"].json)["result"] == 1
    assert json.loads(r["2:lost"].json) == {"arguments": None, "id": "2:lost", "name": None, "result": 2}


def test_plain_turns_nulls_and_copies(spark):
    r = rows(spark, [(1, 0, "user", "hi  there"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (None, 3, "user", ""), (None, None, None, None), (3, 5, "assistant", None), (1, 0, "user", "hi  there")])
    assert {k: (v.status, v.n_results, v.errors) for k, v in r.items()} == {"1:0": ("linked", 2, ""), "1:2": ("no_result", 0, "missing:text"), ":3": ("no_result", 0, ""), "3:4": ("orphan", 1, "")}
    assert r["1:0"].json == '{"arguments":{"text":"hi  there","words":2},"id":"1:0","name":"reply","result":"yes"}'


def test_empty_table(spark):
    assert rows(spark, []) == {}


def depth(refs):
    """Levels by definition: {call: level or None}."""
    out, open_ = {}, set(refs)
    while free := [c for c in open_ if all(r in out for r in refs[c] if r in refs)]:
        out |= {c: 1 + max((out[r] for r in refs[c] if r in refs), default=-1) for c in free}
        open_ -= set(free)
    return {c: out.get(c) for c in refs}


def test_levels_against_their_definition(spark):
    rng = random.Random(5)
    refs = {f"1:a{i}": [f"1:a{i - 1}"] if i else [] for i in range(70)}  # a long chain that points back
    refs |= {f"1:b{i}": [f"1:b{(i + 1) % 9}"] for i in range(9)} | {"1:c": ["1:b3"], "1:d": ["1:d"], "1:e": ["1:c", "1:a9"]}  # circles, and calls that need them
    refs |= {f"1:r{i}": sorted({f"1:r{rng.randrange(i)}" for _ in range(rng.randint(0, 3))} if i else set()) for i in range(60)}
    refs["1:f"] = ["1:a9", "1:nowhere"]
    calls = spark.createDataFrame([(1, k, i, "add", '{"a":1}', v, False) for i, (k, v) in enumerate(refs.items())], "conv_id long, call_id string, pos long, name string, arguments string, refs array<string>, implied boolean")
    results = spark.createDataFrame([], "conv_id long, call_id string, pos long, content string")
    got = {r.call_id: r for r in toolcalls.link(calls, results, SCHEMAS).collect()}
    assert {k: r.topo_level for k, r in got.items()} == depth(refs)
    assert got["1:f"].errors == "ref:1:nowhere" and got["1:a9"].errors == ""
    assert all((r.status == "cycle") == (r.topo_level is None) for r in got.values())


def test_plain_turns_have_levels_and_other_columns_may_clash(spark):
    m = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], "x " * (90_000 if t == 4 else 1), "c", 7) for t in range(12)] + [(1, 40, "user", "later", "c", 7), (None, None, "user", "?", "c", 7)], "conv_id long, turn long, role string, text string, call_id string, topo_level long")
    got = {r.call_id: (r.topo_level, r.errors) for r in toolcalls.link(toolcalls.chat_calls(m), toolcalls.chat_results(m)).collect()}
    assert got == {f"1:{t}": (t // 2, "") for t in range(0, 12, 2)} | {"1:40": (0, ""), ":": (0, "")}


def test_marked_call_without_identifier_or_references(spark):
    r = rows(spark, [(1, 0, "assistant", call(name="add", arguments={"a": 1}, refs=None)), (1, 1, "assistant", "<tool_call>no json</tool_call>"), (1, 2, "assistant", call(id="k", name="add", arguments={"a": 1}, refs=[None, "k0"]))])
    assert r["1:"].status == "no_result" and r["1:"].topo_level == 0
    assert r["1:k"].errors == "ref:1:k0"  # a null reference is none
