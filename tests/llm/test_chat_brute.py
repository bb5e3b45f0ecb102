"""The whole chat query against a brute-force version over random conversations."""

import json
from collections import Counter, defaultdict

import numpy as np

from contextkit.llm import op02_chat as op
from tests.llm.test_chat import SCHEMA, call

TYPES = {"string": str, "integer": int}


def result(i, text):
    return f'<tool_result>{{"id": "{i}", "content": "{text}"}}</tool_result>'


def blocks(text, kind):
    """The JSON objects in blocks of a kind, of a text made by ``conversations``."""
    return [json.loads(part.split(f"</{kind}>")[0]) for part in (text or "").split(f"<{kind}>")[1:]]


def brute_levels(after):
    level = {}
    for _ in after:
        for k, own in after.items():
            known = {d for d in own if d in after}
            if known <= level.keys():
                level[k] = max((level[d] + 1 for d in known), default=0)
    return level


def brute_problems(name, arguments):
    if name not in op.SCHEMAS:
        return 1
    bad = 0 if isinstance(arguments, dict) else 1
    for key, (kind, required) in op.SCHEMAS[name].items():
        value = arguments.get(key) if isinstance(arguments, dict) else None
        bad += required if value is None else type(value) is not TYPES[kind]
    return bad


def brute(rows):
    """(conv_id, call_id, turn, name, level, result_turn, n_problems, json) by looking at one conversation after another."""
    convs, out = defaultdict(list), []
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    dump = lambda x: json.dumps({k: v for k, v in x.items() if v is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for conv, turns in convs.items():
        calls, results, others = [], [], []
        for turn, role, text in turns:
            implicit = conv is not None and turn is not None
            if implicit and role == "user":
                arguments = {"prompt": text, "turn": turn} if text is not None else {"turn": turn}
                calls.append((f"{conv}-{turn}", turn, "respond", arguments, [f"{conv}-{turn - 2}"]))
            elif implicit and role == "assistant":
                results.append((f"{conv}-{turn - 1}", turn, text))
            elif implicit:
                others.append({"id": None, "kind": "turn", "role": role, "text": text, "turn": turn})
            calls += [(j["id"], turn, j["name"], j["arguments"], j.get("after") or []) for j in blocks(text, "tool_call")]
            results += [(j["id"], turn, j["content"]) for j in blocks(text, "tool_result")]
        after = defaultdict(set)
        for i, *_, own in calls:
            after[i] |= set(own)
        level = brute_levels(after) if conv is not None else {}
        first = {}
        for i, turn, text in sorted(results, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            if i in after and i not in first:
                first[i] = turn, text
            else:
                others.append({"id": i, "kind": "repeated" if i in after else "orphan", "role": "result", "text": text, "turn": turn})
        homes = {}
        for i, turn, *_ in calls:
            homes[turn] = min(homes.get(turn, i), i)
        held = defaultdict(list)
        for item in others:
            if not homes:
                out.append((conv, None, item["turn"], None, None, None, None, dump(item)))
                continue
            home = min((t for t in homes if t >= item["turn"]), default=max(homes))
            held[home, homes[home]].append(item)
        for i, turn, name, arguments, _ in calls:
            found = first.get(i, (None, None))
            rest = {"arguments": arguments, "id": i, "level": level.get(i), "name": name, "result": found[1], "result_turn": found[0], "turn": turn}
            items = sorted(held.get((turn, i), []), key=lambda x: [(x[k] is not None, x[k] or 0) if k == "turn" else (x[k] is not None, x[k] or "") for k in ("turn", "kind", "role", "id", "text")])
            rest["unlinked"] = [{k: v for k, v in x.items() if v is not None} for x in items] or None
            out.append((conv, i, turn, name, level.get(i), found[0], brute_problems(name, arguments), dump(rest)))
    return out


def conversations(rng):
    rows = []
    arguments = ['{"prompt":"p","turn":1}', '{"prompt":7,"turn":"x"}', '{"turn":2}', "[1]", '{"a":{"c":1,"b":[true,null]},"prompt":"é","turn":3}']
    for conv in range(40):
        for turn in range(int(rng.integers(1, 14))):
            role = ["user", "assistant", "system", "tool", None][rng.choice(5, p=[0.35, 0.35, 0.1, 0.15, 0.05])]
            text = f"text {rng.integers(5)}" if rng.integers(8) else [None, "", 'say "hi"\\n', "😀 é"][rng.integers(4)]
            if role in ("tool", None) or not rng.integers(4):
                name = lambda: f"c{rng.integers(6)}"
                text = "".join(
                    call(name(), ["respond", "zap"][int(rng.integers(5) == 0)], arguments[rng.integers(5)], [name() for _ in range(rng.integers(3))] if rng.integers(2) else None)
                    if rng.integers(2)
                    else result(name(), f"r{rng.integers(3)}")
                    for _ in range(rng.integers(1, 4))
                )
            rows.append((conv, turn, role, text))
            if not rng.integers(25):
                rows.append(rows[-1])  # a repeated row
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = conversations(np.random.default_rng(21))
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Counter(map(tuple, op.op2_format_chats(spark, str(tmp_path)).collect()))
    want = Counter(brute(rows))
    assert got == want
    assert sum(r[1] is not None and r[4] is None for r in want) and sum(r[1] is None for r in want)
