"""Links, levels, validation and canonical JSON against plain Python."""

import json
import random
from collections import Counter, defaultdict

import pytest
from sheetlake.llm import tool_calls as C
from sheetlake.llm.common import table

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, level string"
SCHEMAS = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
    "a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": "array", "items": {"type": "string"}, "maxItems": 2},
    "c": {"enum": ["x", 1, None]}, "d": {"type": ["string", "null"], "pattern": "^k", "minLength": 2}}}}


def run(spark, calls, results):
    return C.linked_calls(spark.createDataFrame([(*c, "s") for c in calls], CALLS),
                          spark.createDataFrame([(*r, "l") for r in results], RESULTS), SCHEMAS).collect()


def plain_levels(calls):
    ids = {(c[0], c[2]): c for c in calls}
    levels = {}
    while True:
        more = {}
        for key, c in ids.items():
            on = {(c[0], d) for d in c[5] or []} & ids.keys()
            if key not in levels and all(k in levels for k in on):
                more[key] = max((levels[k] + 1 for k in on), default=0)
        if not more:
            return levels
        levels |= more


def test_links_and_levels(spark):
    rng = random.Random(3)
    calls, results = [], []
    for conv in range(12):
        ids = [f"c{i}" for i in range(rng.randint(0, 9))]
        for i, x in enumerate(ids):
            on = rng.sample(ids, min(len(ids), rng.randint(0, 2))) if rng.random() < 0.15 else rng.sample(ids[:i], min(i, rng.randint(0, 2)))
            calls.append((conv, rng.randint(0, 50), x, "f", '{"a":1}', rng.choice([on, on + ["gone"], None if not on else on])))
        results += [(conv, rng.randint(0, 60), rng.choice(ids + ["none"]), f"r{n}") for n in range(rng.randint(0, 8))]
    out = run(spark, calls, results)
    levels, by_id = plain_levels(calls), defaultdict(list)
    for r in results:
        by_id[r[0], r[2]].append((r[1], r[3]))
    got = {(r.conv_id, r.call_id): r for r in out if r.status in ("linked", "no_result")}
    assert set(got) == {(c[0], c[2]) for c in calls}
    for key, r in got.items():
        assert r.level == levels.get(key)
        assert r.status == ("linked" if by_id[key] else "no_result") and (r.n_results or 0) == len(by_id[key])
        if by_id[key]:
            turn, content = min(by_id[key])
            assert r.result_turn == turn and json.loads(r.line)["result"] == content
    assert sum(r.status == "orphan" for r in out) == sum(len(v) for k, v in by_id.items() if k not in got)


def test_odd_rows(spark):
    calls = [(1, 5, "x", "f", '{"a":1}', []), (1, 2, "x", "f", '{"a":2}', ["x"]), (1, 2, "x", "f", '{"a":2}', ["x"]),
             (None, 1, "y", "f", "{}", None), (1, 1, None, "f", "{}", None), (2, None, "z", "g", None, None),
             (2, 1, "w", "f", None, []), (3, 1, "p", "f", '{"a":3}', ["q"]), (3, 2, "q", "f", '{"a":3}', ["p"])]
    results = [(None, 1, "y", "r"), (1, 3, None, "r"), (9, 1, "x", "r"), (1, 3, "x", None)]
    out = run(spark, calls, results)
    status = Counter((r.conv_id, r.call_id, r.status, r.level) for r in out if r.status != "unnamed")
    assert status == Counter([
        (1, "x", "linked", None), (1, "x", "duplicate", None), (1, "x", "duplicate", None), (2, "z", "no_result", 0),
        (2, "w", "no_result", 0), (3, "p", "no_result", None), (3, "q", "no_result", None), (9, "x", "orphan", None)])
    assert sum(r.status == "unnamed" for r in out) == 4 and len(out) == 12
    assert [r.errors for r in out if r.call_id == "w"] == ["no arguments"]
    assert run(spark, [], []) == [] and [r.status for r in run(spark, [], results[2:3])] == ["orphan"]


@pytest.mark.parametrize("text,wrong", [
    ('{"a":5}', []), ('{"a":5.0,"c":1.0,"b":["q"]}', []), ('{"a":0}', ["$.a: below 1"]), ('{"a":true}', ["$.a: not integer"]),
    ('{"b":["x",1,"y"],"a":10}', ["$.a: above 9", "$.b: wrong length", "$.b[1]: not string"]), ('{}', ["$: a is missing"]),
    ('{"a":1,"z":1}', ["$: z is not known"]), ('{"a":1,"c":"y"}', ["$.c: not one of the values"]), ('[]', ["$: not object"]),
    ('{"a":1,"d":null}', []), ('{"a":1,"d":"j"}', ["$.d: wrong length", "$.d: does not match"])])
def test_schema_faults(text, wrong):
    value, fault = C.parsed(text)
    assert fault is None and sorted(C.faults(value, SCHEMAS["f"])) == sorted(wrong)


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "{", "NaN", "", '{"a":1e999}', '"\ud800' + "[" * 100000])
def test_not_json(text):
    assert C.parsed(text)[1]


def test_canonical_json():
    assert C.canonical(json.loads('{"b": 1.0, "a": [1e2, 0.5, -0.0, "é\\u00e9\\n", null, true]}')) == '{"a":[100,0.5,0,"éé\\n",null,true],"b":1}'
    rng = random.Random(1)
    for _ in range(200):
        value = {str(rng.random()): rng.choice([rng.random(), rng.randint(-9, 9), "x\t\"", None, [1, {"q": {}}]]) for _ in range(5)}
        text = C.canonical(value)
        assert json.loads(text) == value and C.canonical(json.loads(text)) == text
        assert C.canonical(dict(reversed(value.items()))) == text


def test_deep_chain_and_hot_conversation(spark):
    calls = [(1, i, f"c{i}", "f", '{"a":1}', [f"c{i - 1}"] if i < 500 else ["c0"]) for i in range(3000)]
    calls += [(1, 1, "both", "f", '{"a":1}', ["c499", "c7"]), (1, 1, "after", "f", '{"a":1}', ["both"])]
    calls += [(2, i, f"r{i}", "f", '{"a":1}', [f"r{(i + 1) % 50}"]) for i in range(50)]
    calls += [(2, 1, "into", "f", '{"a":1}', ["r3"]), (2, 1, "two", "f", '{"a":1}', ["into", "free"]), (2, 1, "free", "f", '{"a":1}', [])]
    out = run(spark, calls, [(1, 9, f"c{i}", "ok") for i in range(3000)])
    levels = plain_levels(calls)
    assert levels[1, "after"] == 501 and (2, "two") not in levels
    assert all(r.level == levels.get((r.conv_id, r.call_id)) for r in out) and len(out) == len(calls)


def test_given_table(spark):
    turns = table(spark, "/root/testdata/sf0.01", "conversations")
    calls, results = C.chat_calls(turns)
    out = C.linked_calls(calls, results, C.CHAT_SCHEMAS).collect()
    rows = {(r.conv_id, r.turn): r for r in turns.collect()}
    asked = {k for k, r in rows.items() if r.role == "assistant"}
    assert {(r.conv_id, r.turn) for r in out if r.turn is not None} == asked
    levels = plain_levels([tuple(r) for r in calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on").collect()])
    faults = Counter()
    for r in out:
        if r.turn is not None:
            answer = rows.get((r.conv_id, r.turn + 1))
            assert (r.status == "linked") == (answer is not None and answer.role == "user")
            assert r.level == levels.get((r.conv_id, r.call_id))
            faults["cycle"] += r.level is None
            faults["several"] += r.turn in (5, 9)
            faults["broken"] += r.line is None
            faults["limit"] += "$.limit: above 50" in r.errors
            assert (r.line is None) == (r.conv_id % 47 == 11) == r.errors.startswith("not JSON")
            if r.line:
                message = json.loads(r.line)
                assert rows[r.conv_id, r.turn].text in message["function"]["arguments"].values()
                assert message.get("result") == (answer.text if r.status == "linked" else None)
    assert all(faults[k] for k in ("several", "broken", "limit"))


def test_several_parents_from_a_chat(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"text {t}") for c in (1, 7) for t in range(14)]
    calls, results = C.chat_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = [tuple(r) for r in calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on").collect()]
    assert max(len(r[5]) for r in rows) == 2
    out = C.linked_calls(calls, results, C.CHAT_SCHEMAS).where("turn IS NOT NULL").collect()
    assert {(r.conv_id, r.call_id): r.level for r in out if r.level is not None} == plain_levels(rows)
    assert {r.conv_id for r in out if r.level is None} == {7} and sum(r.conv_id == 1 for r in out) == 7
