import json
import random

import pytest

from tests.llm.frames import rows
from tidemark.llm import chat_format as C

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, level int"


def linked(spark, calls, results):
    out = C.link(
        spark.createDataFrame([(*c, "clash") for c in calls], CALLS),
        spark.createDataFrame([(*r, 9) for r in results], RESULTS),
    )
    return {(r["conv_id"], r["turn"], r["kind"]): r for r in rows(out)}


def test_links_levels_and_odd_cases(spark):
    calls = [
        (1, 0, "a", "search", '{"query":"x","limit":3}'),
        (1, 2, "b", "search", '{"query":"$a"}'),
        (1, 4, "c", "search", '{"query":"$b","limit":"3"}'),
        (1, 5, "d", "search", '{"query":["$e"]}'),
        (1, 6, "e", "search", '{"query":"$d"}'),
        (1, 7, "f", "nothing", "{}"),
        (1, 8, "a", "search", '{"query":"again"}'),
        (1, 9, None, "search", None),
        (1, 10, "g", "search", "no json"),
        (1, 11, "h", "search", '{"query":"$zz"}'),
        (1, 12, "i", "search", '{"query":"1","more":{"b":1,"a":[ 2 , null ]}}'),
        (None, 0, "a", "search", '{"query":"\\u00e9\\n"}'),
    ]
    results = [(1, 1, "a", "ok\n"), (1, 3, "b", None), (1, 13, "a", "late"), (1, 14, "q", "none"), (1, 2, "h", "before"), (2, 1, "a", "other")]
    got = linked(spark, calls, results)
    assert len(got) == len(calls) + len(results)
    call = lambda t: got[1, t, "call"]
    assert [call(t)["status"] for t in (0, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12)] == [
        "linked", "linked", "open", "cyclic", "cyclic", "open", "duplicate", "open", "open", "unresolved", "open",
    ]
    assert [call(t)["level"] for t in (0, 2, 4, 5, 11)] == [0, 2, 4, None, 0]
    assert [call(t)["valid"] for t in (0, 2, 4, 5, 6, 7, 9, 10, 12)] == [True, True, False, False, True, False, False, False, False]
    assert [got[1, t, "result"]["status"] for t in (1, 3, 13, 14, 2)] == ["linked", "linked", "duplicate", "orphan", "early"]
    assert got[2, 1, "result"]["status"] == "orphan" and got[1, 3, "result"]["level"] == 3
    assert call(12)["json"] == '{"arguments":{"more":{"a":[2,null],"b":1},"query":"1"},"id":"i","name":"search","type":"call"}'
    assert json.loads(got[1, 1, "result"]["json"]) == {"content": "ok\n", "id": "a", "type": "result"}
    assert json.loads(call(10)["json"])["arguments"] == "no json" and json.loads(call(9)["json"])["arguments"] == {}


def test_long_chain_and_empty(spark):
    n = 9
    calls = [(1, 2 * i, f"c{i}", "search", json.dumps({"query": f"$c{i - 1}" if i else "x"})) for i in range(n)]
    got = linked(spark, calls, [(1, 2 * i + 1, f"c{i}", "r") for i in range(n)])
    assert [got[1, 2 * i, "call"]["level"] for i in range(n)] == [2 * i for i in range(n)]
    assert linked(spark, [], []) == {}


def brute_levels(needs):
    """Longest paths by repeated relaxation; None on or behind a cycle."""
    level = {}
    while True:
        more = {c: max((level[n] + 2 for n in ns), default=0) for c, ns in needs.items() if c not in level and all(n in level for n in ns)}
        if not more:
            return level
        level.update(more)


def test_levels_of_any_graph(spark):
    r = random.Random(4)
    needs = {}
    for conv in range(12):
        n = 40
        for i in range(n):
            many = r.choice([0, 1, 1, 1, 1, 2, 3]) if conv % 2 else 1
            low = 0 if conv % 3 == 0 and r.random() < 0.1 else max(0, i - 4)  # some lead back or on
            high = n if conv % 4 == 1 and r.random() < 0.05 else i
            needs[conv, i] = set() if i == 0 else {r.randrange(low, max(high, low + 1)) for _ in range(many)}
    calls = [(c, i, str(i), "search", json.dumps({"query": [f"${x}" for x in sorted(ns)]})) for (c, i), ns in needs.items()]
    got = linked(spark, calls, [])
    for conv in range(12):
        want = brute_levels({i: ns for (c, i), ns in needs.items() if c == conv})
        assert {i: got[conv, i, "call"]["level"] for i in range(40)} == {i: want.get(i) for i in range(40)}


def test_a_very_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 3000, []
    keep = C.stored_at
    monkeypatch.setattr(C, "stored_at", lambda df, label: rounds.append(label) or keep(df, label))
    calls = [(1, 2 * i, f"c{i}", "search", json.dumps({"query": f"$c{i - 1}" if i else "x"})) for i in range(n)]
    got = linked(spark, calls, [])
    assert all(got[1, 2 * i, "call"]["level"] == 2 * i for i in range(n))
    assert len(rounds) <= 15


def test_null_conversation_and_very_long_content(spark):
    long = "x" * 2_000_000
    got = linked(spark, [(None, 0, "a", "search", '{"query":"1"}'), (1, 0, "a", "search", json.dumps({"query": long}))], [(None, 1, "a", "r"), (1, 1, "a", long)])
    assert got[None, 0, "call"]["status"] == "open" and got[None, 1, "result"]["status"] == "orphan"
    assert json.loads(got[1, 1, "result"]["json"])["content"] == long and got[1, 0, "call"]["valid"]


@pytest.mark.parametrize("turns", [[(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "x"), (1, 3, "tool", None), (1, 5, "user", "a")]])
def test_plain_conversations(spark, turns):
    frame = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, json string")
    got = {r["turn"]: r for r in rows(C.format_conversations(frame))}
    assert [got[t]["status"] for t in (0, 1, 2, 3, 5)] == ["linked", "linked", "plain", "plain", "unresolved"]
    assert not got[0]["valid"] and got[5]["valid"]
    assert all(json.loads(r["json"]) for r in got.values())
