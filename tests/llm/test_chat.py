import json

import numpy as np
from pyspark.sql import functions as F

from contextkit.llm import op02_chat as op

SCHEMA = "conv_id long, turn long, role string, text string, level string"


def call(i, name="respond", arguments='{"turn": 1, "prompt": "p"}', after=None):
    return f'<tool_call>{{"id": "{i}", "name": "{name}", "arguments": {arguments}{"" if after is None else ", " + chr(34) + "after" + chr(34) + ": " + json.dumps(after)}}}</tool_call>'


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {(r.conv_id, r.call_id): r for r in op.link_tool_calls(*op.explicit_calls(df)).collect()}


def test_links_levels_and_problems(spark):
    rows = [
        (1, 0, "assistant", call("a") + call("b", after=["a"]) + call("c", after=["a", "b", "nowhere"])),
        (1, 1, "tool", '<tool_result>{"id": "a", "content": "late"}</tool_result>'),
        (1, 0, "tool", '<tool_result>{"id": "a", "content": "first"}</tool_result>'),
        (2, 0, "assistant", call("a", arguments='{"turn": "1"}') + call("x", name="zap") + call("y", arguments='{"a": 1, "a": 2}') + call("z", arguments="[1]")),
        (3, 0, "assistant", call("p", after=["q"]) + call("q", after=["p"]) + call("r", after=["q"])),
        (None, None, None, None),
        (4, 0, "user", ""),
    ]
    got = linked(spark, rows)
    assert {k[1]: got[k].level for k in got if k[0] == 1} == {"a": 0, "b": 1, "c": 2}
    assert json.loads(got[1, "a"].json) == {"arguments": {"prompt": "p", "turn": 1}, "id": "a", "level": 0, "name": "respond", "result": "first", "result_turn": 0, "turn": 0}
    assert got[1, "a"].json == json.dumps(json.loads(got[1, "a"].json), sort_keys=True, separators=(",", ":"))
    assert got[1, "b"].result_turn is None
    assert {k[1]: list(got[k].problems) for k in got if k[0] == 2} == {"a": ["prompt is missing", "turn is not integer"], "x": ["unknown tool"], "y": ["not JSON"], "z": ["prompt is missing", "turn is missing", "not an object"]}
    assert {k[1]: got[k].level for k in got if k[0] == 3} == {"p": None, "q": None, "r": None}
    assert len(got) == 10


def test_repeated_calls_and_results_do_not_multiply(spark):
    rows = [(1, 0, "assistant", call("a"))] * 20 + [(1, 1, "tool", '<tool_result>{"id": "a", "content": "r"}</tool_result>')] * 20
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = op.link_tool_calls(*op.explicit_calls(df))
    assert got.count() == 20 and got.where("result_turn = 1").count() == 20


def test_query(spark, tmp_path):
    rows = [(7, 0, "system", "s"), (7, 1, "user", 'hi "you"'), (7, 2, "assistant", "é 😀\n"), (7, 3, "user", "x" * 300_000), (8, 0, "user", None), (None, 0, "user", "lost"), (9, None, "user", "lost")]
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.call_id: r for r in op.op2_format_chats(spark, str(tmp_path)).collect()}
    assert {k: (r.level, r.result_turn, r.n_problems) for k, r in got.items()} == {"7-1": (0, 2, 0), "7-3": (1, None, 0), "8-0": (0, None, 1)}
    assert json.loads(got["7-1"].json)["result"] == "é 😀\n"


def test_no_turn_and_no_result_is_lost(spark, tmp_path):
    result = lambda i, text: f'<tool_result>{{"id": "{i}", "content": "{text}"}}</tool_result>'
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "hello"), (1, 2, "assistant", "fine"), (1, 3, "assistant", "more"), (1, 4, "system", "middle"), (1, 5, "user", call("a")), (1, 6, "tool", result("a", "first") + result("a", "second") + result("b", "stray"))]
    rows += [(2, 0, "system", "only"), (2, 1, "assistant", "said"), (3, 0, None, "unknown")]
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op.op2_format_chats(spark, str(tmp_path)).collect()
    made = [(r.conv_id, r.call_id, json.loads(r.json)) for r in got]
    held = {k: [(x["turn"], x["kind"], x["text"]) for x in j.get("unlinked", []) if x["turn"] != 6 or x["kind"] != "turn"] for _, k, j in made if k}
    assert held == {"1-1": [(0, "turn", "rules")], "1-5": [(3, "orphan", "more"), (4, "turn", "middle"), (6, "orphan", "stray"), (6, "repeated", "second")], "a": []}
    assert sorted((c, j["kind"], j["text"]) for c, k, j in made if not k) == [(2, "orphan", "said"), (2, "turn", "only"), (3, "turn", "unknown")]
    assert all(r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":")) for r in got)


def test_empty_table(spark):
    assert op.link_tool_calls(*op.implicit_calls(spark.createDataFrame([], SCHEMA))).collect() == []
    assert op.levels(op.explicit_calls(spark.createDataFrame([], SCHEMA))[0]).agg(F.count("*")).first()[0] == 0


def test_levels_of_random_graphs(spark):
    rng = np.random.default_rng(6)
    calls, want = [], {}
    for conv in range(6):
        n = 40
        after = {k: [int(x) for x in rng.choice(k, min(k, [1, 1, 1, 2, 3][rng.integers(5)]), replace=False)] if k and rng.integers(8) else [] for k in range(n)}
        after[7] = [7] if conv == 2 else after[7]
        after[5] = [30] if conv == 3 else after[5]  # perhaps a cycle
        level = {}
        for _ in range(n):
            level |= {k: max([-1, *(level[d] for d in after[k])]) + 1 for k in after if all(d in level for d in after[k])}
        calls += [(conv, str(k), [*map(str, after[k]), "nowhere"]) for k in after]
        want |= {(conv, str(k)): v for k, v in level.items()}
    got = op.levels(spark.createDataFrame(calls, "conv_id long, call_id string, after array<string>"))
    assert {(r.conv_id, r.call_id): r.level for r in got.collect()} == want
    chain = spark.range(1000).selectExpr("1L AS conv_id", "string(id) AS call_id", "array(string(id - 1)) AS after")
    assert op.levels(chain).where("level = int(call_id)").count() == 1000
