"""Linked, ordered and validated chats against a plain version."""

import json
import random

import pytest

from pyspark.sql import functions as F

from tests.llm import brute
from twinsift.llm import chat, queries
from twinsift.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, kind string, call_id string, name string, arguments string, after array<string>"
TOOLS = {"f": {"x": ("integer", True), "s": ("string", False), "l": ("array", False), "n": ("number", False)}}


def call(conv, turn, i, arguments='{"x": 1}', after=None, name="f"):
    return (conv, turn, "assistant", None, "call", i, name, arguments, after)


def result(conv, turn, i):
    return (conv, turn, "tool", f"of {i}", "result", i, None, None, None)


def test_order_status_and_json(spark):
    rows = [
        (1, 0, "user", "hi", "message", None, None, None, None),
        call(1, 1, "a", '{"x": 1, "s": "é\\n"}', ["b"]),
        result(1, 2, "a"),
        call(1, 3, "b", '{ "s" : "y", "x":2 }', ["c"]),
        call(1, 4, "c"),
        result(1, 5, "c"),
        result(1, 3, "b"),
        (1, 6, "user", "bye", "message", None, None, None, None),
        call(2, 0, "a", after=["b"]),
        call(2, 1, "b", after=["a"]),
        call(2, 2, "d", after=["d"]),
        call(2, 3, "e", '{"x": "1"}'),
        call(2, 4, "f", '{"x": 1, "y": 1}'),
        call(2, 5, "g", "{}"),
        call(2, 6, "h", "not json"),
        call(2, 7, "i", name="g"),
        call(2, 8, "j", after=["z"]),
        call(2, 9, "k", '{"x": 1, "n": 1.5, "l": []}'),
        call(2, 10, "k"),
        result(2, 11, "k"),
        result(2, 12, "k"),
        result(2, 13, "none"),
        call(2, 14, None),
        call(2, 15, "m", None),
        call(None, 1, "a"),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3), TOOLS).orderBy("row").collect()
    assert [r.row for r in got] == list(range(len(rows)))
    assert [(r.turn, r.kind) for r in got if r.conv_id == 1] == [(0, "message"), (4, "call"), (5, "result"), (3, "call"), (3, "result"), (1, "call"), (2, "result"), (6, "message")]
    want = "circle circle circle bad_arguments bad_arguments bad_arguments bad_arguments unknown_tool missing_need ok duplicate ok repeated orphan unidentified bad_arguments".split()
    assert [r.status for r in got if r.conv_id == 2] == want
    assert [r.status for r in got if r.conv_id is None] == ["unidentified"]
    by = {(r.conv_id, r.turn, r.kind): r.json for r in got}
    assert by[1, 3, "call"] == '{"arguments":{"s":"y","x":2},"call_id":"b","name":"f","role":"assistant","text":null}'
    assert json.loads(by[2, 6, "call"])["arguments"] == "not json" and json.loads(by[1, 1, "call"])["arguments"]["s"] == "é\n"


def test_query_takes_every_turn(spark, sf_dir):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    want = {}
    for (conv, turn), r in turns.items():
        user = lambda t: (conv, t) in turns and turns[conv, t].role == "user"  # noqa: B023, E731
        if r.role == "user":
            lines, short = "\n" in r.text, len(r.text) < 200
            status = "ok" if (conv, turn + 1) in turns and turns[conv, turn + 1].role == "assistant" else "unanswered"
            status = "bad_arguments" if lines else status
            needs = turn & 2 == 0
            status = "missing_need" if needs and not user(turn + 2) else status
            words = len(r.text.split(" "))
            body = {"arguments": {"query": r.text, "words": str(words) if lines else words}, "call_id": str(turn), "name": "note" if short else "ask", "role": "user", "text": r.text}
            ends = turn + 2 + (turns.get((conv, turn + 3)) is not None and turns[conv, turn + 3].role == "assistant")
            at = (ends, 2) if needs and user(turn + 2) else (turn, 0)
        elif r.role == "assistant":
            at = (turn, 1)
            status = "ok" if user(turn - 1) else "orphan"
            if user(turn - 1) and (turn - 1) & 2 == 0 and user(turn + 1):
                at = (turn + 1 + (turns.get((conv, turn + 2)) is not None and turns[conv, turn + 2].role == "assistant"), 3)
            body = {"call_id": str(turn - 1), "role": r.role, "text": r.text}
        else:
            at, status, body = (turn, 0), "ok", {"role": r.role, "text": r.text}
        want[conv, turn] = (conv, *at, turn), status, body
    got = queries.op2_chat(spark, sf_dir).orderBy("row").collect()
    assert [(r.conv_id, r.turn) for r in got] == sorted(want, key=lambda k: want[k][0])
    assert all(r.status == want[r.conv_id, r.turn][1] and json.loads(r.json) == want[r.conv_id, r.turn][2] for r in got)
    assert {"ok", "bad_arguments", "missing_need", "unanswered"} <= {r.status for r in got}


def test_query_against_a_plain_version(spark, sf_dir):
    """Every conversation, linked, ordered and written as one process does it."""
    messages = queries.chat_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    want = brute.chats([r.asDict() for r in messages.collect()], queries.TOOLS)
    got = sorted(map(tuple, queries.op2_chat(spark, sf_dir).collect()))
    assert len({r[5] for r in want}) > 2 and got == want


@pytest.mark.parametrize("seed", range(4))
def test_random_calls_against_a_plain_version(spark, seed):
    r = random.Random(seed)
    tools = {"f": {"x": ("integer", True), "y": ("string", False)}, "g": {"z": ("boolean", False)}}
    rows = []
    for _ in range(120):
        kind = r.choice(["call", "call", "result", "message", None])
        arguments = r.choice(['{"x": 1}', '{"y":"é", "x" : 2}', '{"x": "1"}', "{}", '{"z": true}', "not json", None, '{"x": 1, "w": 2}', "[1]"])
        after = r.choice([None, [], [str(r.randrange(8))], [str(r.randrange(8)), str(r.randrange(8))]]) if seed else None
        rows.append((r.choice([1, 2, 3, None]), r.choice([*range(20), None]), "a", r.choice(["t", "", None]), kind, r.choice([*map(str, range(8)), None]), r.choice(["f", "g", "h", None]), arguments, after))
    columns = "conv_id long, turn long, role string, text string, kind string, call_id string, name string, arguments string, after array<string>"
    df = spark.createDataFrame(rows, columns).coalesce(1)
    want = brute.chats([x.asDict() for x in df.collect()], tools)
    assert sorted(map(tuple, chat.format_chats(df, tools).collect())) == want


@pytest.mark.parametrize("extra", ["c", "r", "level", "eff", "lacks", "key", "need", "_at", "status", "json", "row", "wrong", "to"])
def test_columns_of_any_name(spark, extra):
    rows = [(*call(1, 0, "a", after=["b"]), 7), (*call(1, 1, "b"), 8), (*result(1, 2, "a"), 9)]
    got = chat.format_chats(spark.createDataFrame(rows, f"{SCHEMA}, {extra} int"), TOOLS).orderBy("row").collect()
    assert [(r.call_id, r.kind) for r in got] == [("b", "call"), ("a", "call"), ("a", "result")]


def test_empty_table(spark):
    got = chat.format_chats(spark.createDataFrame([], SCHEMA), TOOLS)
    assert got.count() == 0 and got.columns == ["row", "conv_id", "turn", "kind", "call_id", "status", "json"]


def test_a_long_chain_takes_logarithmic_rounds(spark):
    """10,000 calls, each needing the next, and a circle of 3,000 that others lead into."""
    n = 10_000
    nodes = spark.range(n + 3_010).selectExpr("id AS key", "id AS turn", "id AS last")
    edges = spark.range(n - 1).selectExpr("id AS key", "id + 1 AS need").unionByName(spark.range(n, n + 3_010).selectExpr("id AS key", f"IF(id = {n + 2_999}, {n}, IF(id >= {n + 3_000}, {n} + id % 7, id + 1)) AS need"))
    rounds = []
    got = {r.key: (r.eff, r.level) for r in chat.placed(Scratch(spark), nodes, edges, rounds).collect()}
    assert got == {k: (n - 1, n - 1 - k) for k in range(n)}
    assert len(rounds) <= 16


@pytest.mark.parametrize("seed", range(3))
def test_needs_of_any_shape(spark, seed):
    """Chains, branches and circles against a plain search."""
    r = random.Random(seed)
    n = 120
    needs = {k: r.sample(range(n), r.choice([0, 1, 1, 1, 2, 3])) if r.random() < 0.3 else [x for x in r.sample(range(k + 1, k + 9), r.choice([0, 1, 1, 2])) if x < n] for k in range(n)}
    turn = {k: r.randrange(50) for k in range(n)}
    last = {k: turn[k] + r.randrange(9) for k in range(n)}
    want, open_ = {}, set(range(n))
    while ready := [k for k in open_ if all(x in want for x in needs[k])]:
        want |= {k: (max([turn[k], *(max(want[x][0], last[x]) for x in needs[k])]), 1 + max((want[x][1] for x in needs[k]), default=-1)) for k in ready}
        open_ -= set(ready)
    nodes = spark.createDataFrame([(k, turn[k], last[k]) for k in range(n)], "key long, turn long, last long")
    edges = spark.createDataFrame([(k, x) for k, v in needs.items() for x in v], "key long, need long")
    got = {r.key: (r.eff, r.level) for r in chat.placed(Scratch(spark), nodes, edges).collect()}
    assert got == want


def test_equal_numbers_read_alike(spark):
    text = json.dumps('1.0 \\" 1e2 \\\\, "2.0"')
    same = [["1", "1.0", "1e0", "10e-1", "100E-2"], ["100", "1e2", "100.00", "1.0e+2"], ["0", "-0", "-0.0", "0e5"], ["0.00125", "1.25e-3", "125E-5"], ["1" + "0" * 24, "1e24"], ["-2.5", "-25e-1"]]
    df = spark.createDataFrame([(k, x) for k, v in enumerate(same) for x in v] + [(9, '1234567890123456789012345')], "k int, x string")
    got = {}
    for r in df.select("k", chat.canonical_json(F.parse_json(F.concat(F.lit('{"b":['), "x", F.lit('],"a":' + text + "}")))).alias("j")).collect():
        got.setdefault(r.k, set()).add(r.j)
    tail = lambda n: {'{"a":' + text + ',"b":[' + n + "]}"}
    assert got == {0: tail("1"), 1: tail("100"), 2: tail("0"), 3: tail("0.00125"), 4: tail("1" + "0" * 24), 5: tail("-2.5"), 9: tail("1234567890123456789012345")}


def test_nested_schemas(spark):
    schema = {"type": "object", "properties": {"id": {"type": "integer", "minimum": 1, "maximum": 1e30}, "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}, "min_items": 1}, "at": {"type": "object", "properties": {"x": "number", "y": {"type": ["number", "null"]}}, "required": ["x"]}, "any": {"type": "object"}}, "required": ["id"]}
    cases = {
        '{"id": 1}': True, '{"id": 1.0}': True, '{"id": 1e2}': True, '{"id": 1234567890123456789012345}': True, '{"id": 1.5}': False, '{"id": 0}': False, '{"id": "1"}': False, '{"id": true}': False, "{}": False, "[]": False, "1": False,
        '{"id":1,"tags":["a","b"]}': True, '{"id":1,"tags":["a","c"]}': False, '{"id":1,"tags":[]}': False, '{"id":1,"tags":["a",null]}': False, '{"id":1,"tags":"a"}': False,
        '{"id":1,"at":{"x":1.5,"y":null}}': True, '{"id":1,"at":{"y":1}}': False, '{"id":1,"at":{"x":1,"z":1}}': False, '{"id":1,"any":{"p":[{}]}}': True, '{"id":1,"more":1}': False, "null": False,
    }
    df = spark.createDataFrame(list(cases.items()), "x string, want boolean")
    got = {r.x: r.ok for r in df.select("x", chat.conforms(F.parse_json("x"), schema).alias("ok")).collect()}
    assert got == cases
