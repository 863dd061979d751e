"""Conversation repair against a plain search from the end, on the whole table, odd rows, and parsed in chunks."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from twinsift.llm import queries, repair

SPACES = " \t\n\r\x0b\x0c"
ALLOWED = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """{conv_id: [(turn, role, text)]} after damage; a conversation that lost all its rows has an empty list."""
    out = {}
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else blank(role), "" if kind == 1 else blank(text)
        text = re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def least(initials, faults):
    """The least (cost, audit): every way to go on from a row in a state, from the end backwards."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * len(initials) + 2000))

    @lru_cache(None)
    def rest(at, state, inserted):
        best = [(0, "")] if at == len(initials) and state in (0, 3) else []
        if inserted < 3:
            best += [(c + 3, "I" + a) for t, to in moves[state].items() if t != "s" for c, a in rest(at, to, inserted + 1)]
        if at < len(initials):
            best += [(c + 4, "D" + a) for c, a in rest(at + 1, state, 0)]
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                for t, to in moves[state].items():
                    edit = (0, "K") if t == initials[at] else (3, "R") if t != "s" else None
                    if edit:
                        best += [(c + more + edit[0], edit[1] + a) for c, a in rest(at + 1, to, 0)]
        return [min(best)] if best else []

    return rest(0, 0, 0)[0]


def plain(rows):
    out = []
    for conv, held in damage(rows).items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in held if t is not None]
        faults, seen = [], set()
        for _, role, text in held:
            end = text.strip(SPACES)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in held]
        cost, audit = least(tuple(initials), tuple(faults))
        lines, at, shape = [], 0, ""
        for e in audit:
            if e == "I":
                shape += "u" if shape[-1:] in ("", "s", "a") else "a"
                lines.append({"u": "user:", "a": "assistant:"}[shape[-1]])
                continue
            _, role, text = held[at]
            at += 1
            if e == "K":
                shape += role[:1]
                lines.append(f"{role}:{text}")
            elif e == "R":
                shape += "u" if shape[-1:] in ("", "s", "a") else "a"
                lines.append({"u": "user:", "a": "assistant:"}[shape[-1]] + text)
        assert ALLOWED.fullmatch(shape) and at == len(held)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


def test_query_against_the_plain_version(spark):
    for sf in ("0.001", "0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert rows_of(queries.op13_repair(spark, f"/root/testdata/sf{sf}")) == plain(rows)


def drawn(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t\n", "A longer answer!", "What? so ", None, "Ünï.\x0b", "end.\n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "ux"]
    return [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(4))
def test_odd_rows_whole_and_in_chunks(spark, seed):
    rows = drawn(150, seed)
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], SCHEMA + ", row long, chunk string, gone boolean").repartition(3)
    want = plain(rows)
    assert rows_of(repair.repair(repair.damaged(df))) == want
    assert rows_of(repair.repair(repair.damaged(df), long_rows=5, chunk_rows=4)) == want
    assert rows_of(repair.repair(repair.damaged(df), long_rows=0, chunk_rows=7)) == want


def test_one_long_conversation(spark):
    """Far more rows than a chunk, in one conversation that holds most of the table."""
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"text {k}.", f"text {k}", "again."])) for k in range(700)] + [(2, k, "user", "") for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = rows_of(repair.repair(repair.damaged(df)))
    assert rows_of(repair.repair(repair.damaged(df), long_rows=100, chunk_rows=33)) == whole == plain(rows)


def test_text_identifiers_empty_tables_and_long_texts(spark):
    rows = [("a", 0, "user", "x" * 3_000_000 + "."), ("a", 1, "assistant", "ok."), ("b", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))
    assert rows_of(repair.repair(repair.damaged(df))) == rows_of(repair.repair(repair.damaged(df), long_bytes=1000)) == plain(rows)
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0
