"""Tool-call linking against a plain loop over all messages."""
import json
import random
from collections import defaultdict

import pytest

from shelfledger.llm import chat
from shelfledger.llm.queries import QUERIES

SCHEMAS = {
    "add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "number", "maximum": 9}, "b": {"type": ["integer", "null"]}}},
    "find": {"type": "object", "properties": {"q": {"type": "string", "minLength": 2}, "kind": {"enum": ["x", 1]}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string"}}}},
}


@pytest.mark.parametrize("value, want", [
    ({"b": 1.0, "a": [2.5, "é\n", None, True]}, '{"a":[2.5,"é\\n",null,true],"b":1}'), ("x", '"x"'), (1e300, "1e+300"), ({}, "{}"),
])
def test_canonical(value, want):
    assert chat.canonical(value) == want and json.loads(want) == value


@pytest.mark.parametrize("name, value, want", [
    ("add", {"a": 1, "b": None}, []), ("add", {"a": 10}, ["$.a:maximum"]), ("add", {"b": 1.5, "c": 0}, ["$.a:required", "$.b:type", "$.c:unknown"]),
    ("add", {"a": True}, ["$.a:type"]), ("add", [], ["$:type"]), ("add", None, ["$:type"]), ("find", {"q": "é", "kind": "1", "tags": ["a", 2, "c"]}, ["$.kind:enum", "$.q:minLength", "$.tags:maxItems", "$.tags[1]:type"]),
    ("find", {"kind": 1, "more": 1}, []),
])
def test_violations(name, value, want):
    assert chat.violations(value, SCHEMAS[name]) == want


@pytest.mark.parametrize("seed", range(5))
def test_order_is_topological(seed):
    r = random.Random(seed)
    for _ in range(200):
        n = r.randint(0, 7)
        after = [[r.randrange(n) for _ in range(r.choice([0, 0, 1, 2]))] for _ in range(n)]
        order, cyclic = chat.ordered(after)
        assert sorted(order) == list(range(n))
        reach = {k: set(a) for k, a in enumerate(after)}
        for _ in range(n):
            reach = {k: v | {y for x in v for y in reach[x]} for k, v in reach.items()}
        on_cycle = {k for k in reach if k in reach[k]}
        assert cyclic == {k for k in reach if k in on_cycle or reach[k] & on_cycle}
        for k, a in enumerate(after):
            if k not in cyclic:
                assert all(order.index(x) < order.index(k) for x in a)


def brute(messages, schemas):
    """All events in the form of ``lines``, by loops."""
    events = [[c, *e] for c, t, r, x in messages for e in chat.message_events(t, r, x, schemas)]
    calls, results = defaultdict(list), defaultdict(list)
    late = lambda a, b: a is not None and b is not None and a > b
    order = lambda e: (e[1] is not None, e[1] or 0, e[2])
    for e in events:
        if e[4] == "call" and e[5] is not None:
            calls[e[0], e[5]].append(e)
        if e[4] == "result":
            results[e[0], e[5]].append(e)
    out = []
    for conv, turn, tag, seq, kind, i, role, name, body, problems, refs in events:
        problems, answer, asked = list(problems), None, [c[1] for c in calls[conv, i] if c[1] is not None]
        valid = sorted((r for r in results[conv, i] if asked and late(r[1], min(asked))), key=order)
        if kind == "call":
            if i is not None and valid and late(valid[0][1], turn):
                answer = valid[0]
            if answer is None:
                problems.append("unanswered")
            if len(calls[conv, i]) > 1:
                problems.append("identifier used again")
            bad = set()
            for x in refs:
                told = [c[1] for c in calls[conv, x] if c[1] is not None]
                if not told:
                    bad.add(f"unknown reference {x}")
                elif turn is not None and min(told) >= turn:
                    bad.add(f"later reference {x}")
            problems += sorted(bad)
        elif kind == "result":
            if [conv, turn, tag] not in [r[:3] for r in valid]:
                problems.append("no call before")
            elif order(valid[0]) < (True, turn, tag):
                problems.append("answered before")
        value = {"content": json.loads(body), "role": role}
        if kind == "result":
            value["tool_call_id"] = i
        if kind == "call":
            value = {"arguments": json.loads(body), "id": i, "name": name, "role": role} | ({"result": json.loads(answer[8])} if answer else {})
        out.append((conv, turn, seq, kind, i, answer and answer[1], problems, chat.canonical(value | ({"problems": problems} if problems else {}))))
    return out


def messages(seed):
    r = random.Random(seed)
    rows = []
    for conv in [*range(25), None]:
        ids = [f"c{k}" for k in range(5)]
        for turn in range(r.randint(1, 10)):
            kind = r.choice(["plain", "calls", "result", "result", "odd"])
            if kind == "plain":
                rows.append((conv, turn, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["hi", "", None, "é" * 9])))
            elif kind == "calls":
                calls = [{"id": r.choice(ids), "name": r.choice(["add", "find", "nope"]), "arguments": r.choice([{"a": 1}, {"a": 99}, '{"a": 2}', "{", None, {"q": "xx"}]), "after": r.sample([*ids, "far"], r.choice([0, 0, 1, 2]))} for _ in range(r.randint(0, 3))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls, "content": r.choice([None, "so"])})))
            elif kind == "result":
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": r.choice(ids), "content": r.choice(["r", {"z": 1, "y": [1.0]}, None])})))
            else:
                rows.append((conv, turn, r.choice(["assistant", "tool"]), r.choice(['{"tool_calls": 5}', '{"tool_call_id": 7}', '{"tool_calls": [3, {"id": 1}]}', '{"tool_calls": [{"id": "c1", "arguments": NaN}]}', "[1]", '{"a": 1e999}'])))
            if r.random() < 0.1:
                rows.append(rows[-1])
    return rows


key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize("seed", range(3))
def test_events_are_those_of_the_loop(spark, seed):
    rows = messages(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, line string, seq int").repartition(3)
    got = chat.format_chats(df, SCHEMAS).collect()
    assert key((*r[:6], list(r.problems), r.line) for r in got) == key(brute(rows, SCHEMAS))


def test_missing_turns_long_texts_and_empty_tables(spark):
    rows = [(1, None, "assistant", '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"a": 1}}]}'), (1, 4, "tool", '{"tool_call_id": "a", "content": 1}'), (1, 5, "user", "word " * 200000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.kind: r for r in chat.format_chats(df, SCHEMAS).collect()}
    assert got["call"].problems == ["unanswered"] and got["result"].problems == ["no call before"] and len(got["message"].line) > 10**6
    assert chat.format_chats(df.limit(0), SCHEMAS).collect() == []


def test_query_is_the_loop_over_its_messages(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in chat.with_tools(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    got = QUERIES["op9_chat"](spark, sf).collect()
    assert key((*r[:6], list(r.problems), r.line) for r in got) == key(brute(rows, chat.TOOLS))
    kinds = {p.split(" ")[0] for r in got for p in r.problems}
    assert {"unanswered", "no", "arguments"} <= kinds and sum(r.answer_turn is not None for r in got) > 20


def odd_json(r, depth=0):
    """A value that JSON can hold, with everything that is hard to write again."""
    kind = r.randrange(9 if depth < 4 else 6)
    if kind < 6:
        return [None, True, 10 ** r.randrange(300), -1.5e300, r.choice(["\ud83d", "\udc00x", "\U0001f642", "\x00", "é ", "", '"\\']), 2.0][kind]
    if kind < 8:
        return {r.choice(["a", "\ud800", "query", "id", "", "content", "words"]): odd_json(r, depth + 1) for _ in range(r.randrange(4))}
    return [odd_json(r, depth + 1) for _ in range(r.randrange(4))]


def test_no_text_ends_the_job(spark):
    """Lone surrogates, deep nesting, huge numbers, broken JSON: every message comes out, as JSON that can be read."""
    r = random.Random(11)
    nested = lambda n: "[" * n + "]" * n
    texts = [("tool", '{"tool_call_id":"a","content":"\\ud83d"}'), ("tool", '{"tool_call_id":"\\ud83d","content":1}'), ("tool", '{"tool_call_id":"a","content":1e999}'),
             ("assistant", '{"tool_calls":[{"id":"\\ud83d","name":"\\udfff","after":["\\udc01"],"arguments":{"\\ud800":1}}]}'),
             ("assistant", '{"tool_calls":[{"id":"q","name":"search","arguments":{"query":"\\ud800x","words":1,"\\udfff":2}}]}'),
             ("assistant", "{\"content\":" + "9" * 5000 + "}"), ("tool", "{\"a\":NaN}"), ("user", nested(5000))]
    for n in (100, 199, 200, 201, 900, 1200, 20_000, 200_000):
        texts += [("tool", f'{{"tool_call_id":"d{n}","content":{nested(n)}}}'), ("assistant", nested(n)),
                  ("assistant", json.dumps({"tool_calls": [{"id": f"d{n}", "name": "search", "arguments": nested(n)}]}))]
    for _ in range(400):
        value = odd_json(r)
        texts.append((r.choice(["assistant", "tool"]), json.dumps(r.choice([value, {"tool_call_id": "x", "content": value}, {"content": value, "tool_calls": [{"id": "x", "name": "search", "arguments": value, "after": value}, value]}]))))
    got = chat.format_chats(spark.createDataFrame([(1, k, a, t) for k, (a, t) in enumerate(texts)], "conv_id long, turn long, role string, text string"), chat.TOOLS).collect()
    assert {x.turn for x in got} == set(range(len(texts)))
    for x in got:
        json.loads(x.line)
    deep = {x.turn for x in got if "nested too deep" in x.problems}
    assert deep == {k for k, (a, t) in enumerate(texts) if a != "user" and chat.parsed(t) is chat.DEEP} and len(deep) >= 8
    assert sum("arguments nested too deep" in x.problems for x in got) == 5  # 201 and more
