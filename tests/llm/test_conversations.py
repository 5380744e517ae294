"""Conversation repair against a plain table of all states, whole and in pieces."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from graphask.llm import conversation_repair as cr

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SPACE = " \t\n\x0b\x0c\r"


def _with_inserts(ways):
    ways, changed = dict(ways), True
    while changed:
        changed = False
        for state, (cost, audit, lines) in list(ways.items()):
            to = NEXT[state]
            role = "assistant:" if to == 3 else "user:"
            better = (cost + 3, audit + "I", [*lines, role])
            if to not in ways or better[:2] < ways[to][:2]:
                ways[to], changed = better, True
    return ways


def _brute(rows):
    """Measures, audit and lines of the rows ``turn, role, text`` of one conversation."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    ways = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in _with_inserts(ways).items():
            options = [(state, cost + 4, audit + "D", lines)]
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                to = NEXT[state]
                new = "assistant" if to == 3 else "user"
                options.append((to, cost + 3 + more, audit + "R", [*lines, f"{new}:{text}"]))
                if (state, role[:1]) in KEPT:
                    options.append((KEPT[state, role[:1]], cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for to, *way in options:
                if to not in after or tuple(way[:2]) < after[to][:2]:
                    after[to] = tuple(way)
        ways = after
    ways = _with_inserts(ways)
    cost, audit, lines = min((ways[s] for s in (0, 3) if s in ways), key=lambda w: w[:2])
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return {
        "gaps": gaps,
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
    }


def _brute_digest(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        spaced = [" " if x is None else str(x) for x in (conv, turn)]
        fate = zlib.crc32(":".join(spaced).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            kept[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    order = {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in kept.items()}
    return {conv: _brute(order.get(conv, [])) for conv, *_ in rows}


def _random_rows(rng, conversations=60):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 12)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "é 😀?", "", " \n", None, "end. ", f"words {turn}.", "Same."])
            rows.append((conv, turn, role, text))
    return rows


def test_crossings_are_the_cheapest_and_audit_least():
    rng = random.Random(0)
    for _ in range(1500):
        rows = [(rng.choice([0, 1, 1, 2, 2, 3]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 14))]
        steps = [cr.row_step(*row) for row in rows]
        end = cr.last_state(steps)
        codes = "".join(cr._code(*row) for row in rows)
        audit, _ = cr._actions(codes, 0, end, cr.TAIL[end])
        ways = {0: (0, "")}
        for initial, fault in rows:
            full = {s: w[:2] for s, w in _with_inserts({s: (*w, []) for s, w in ways.items()}).items()}
            ways = {}
            for state, (cost, so_far) in full.items():
                options = [(state, cost + 4, so_far + "D")]
                if fault in (cr.FINE, cr.TRUNCATED):
                    more = 3 if fault else 0
                    options.append((NEXT[state], cost + 3 + more, so_far + "R"))
                    if (state, "sua-"[initial]) in KEPT:
                        options.append((KEPT[state, "sua-"[initial]], cost + more, so_far + "K"))
                for to, *way in options:
                    ways[to] = min(ways.get(to, (1 << 60, "")), tuple(way))
        full = _with_inserts({s: (*w, []) for s, w in ways.items()})
        want = min(full[s][:2] for s in (0, 3) if s in full)
        assert (cr.forward(steps, 0)[0][end] + 3 * cr.TAIL[end], audit) == want
        # The same in pieces, and in pieces of pieces.
        size = rng.randint(1, 4)
        parts = [codes[i : i + size] for i in range(0, len(codes), size)]
        numbers = [cr._piece_numbers(part) for part in parts]
        steps = [cr._as_step(n) for n in numbers]
        end = cr.last_state(steps)
        states = cr.crossings(steps, 0, end)
        pieces = [cr._actions(p, states[i], states[i + 1], cr.TAIL[end] if p is parts[-1] and i == len(parts) - 1 else 0)[0] for i, p in enumerate(parts)]
        assert "".join(pieces) == audit
        whole = cr._joined_numbers(numbers)
        assert cr.last_state([cr._as_step(whole)]) == end
        assert whole[34] == cr._illegal([initial for initial, _ in rows])


def test_digest_equals_brute_force(spark):
    rows = _random_rows(random.Random(4))
    rows += [(None, 0, "user", "Hm."), (None, None, "assistant", "So."), (900, None, "user", "Only."), (901, None, None, None)]
    conversations = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, conv string")
    want = _brute_digest(rows)
    got = {r["conv_id"]: r.asDict() for r in cr.repair_digest(conversations).collect()}
    assert got.keys() == want.keys()
    for conv, measures in want.items():
        assert {k: got[conv][k] for k in measures} == measures, (conv, [r for r in rows if r[0] == conv])


@pytest.mark.parametrize("bits", [(1, 1), (2, 1), (12, 8)])
def test_long_conversations_are_solved_in_pieces(spark, bits):
    rng = random.Random(5)
    rows = [(7, turn, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "cut", "Fine.", "", f"{turn}!"])) for turn in range(300)]
    rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repaired = cr.repair(conversations, *bits)
    got = {r["conv"]: r.asDict() for r in repaired.conversations.collect()}
    for conv in (7, 8):
        want = _brute([r[1:] for r in rows if r[0] == conv])
        assert {k: got[f"c{conv}"][k] for k in want if k in got["c7"]} == {k: v for k, v in want.items() if k != "repaired_sha256"}
        lines = [f"{r['role']}:{r['text']}" for r in repaired.turns.where(f"conv = 'c{conv}'").orderBy("seq", "place").collect()]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want["repaired_sha256"]


def test_damage_and_lost_conversations(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone.")]
    got = cr.repair_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_tables_without_rows_and_rows_that_repeat(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert cr.repair_digest(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, turn, "user", "Same.") for turn in [3] * 40 + [None] * 5]
    repaired = cr.repair(spark.createDataFrame(rows, schema), 2, 1)
    row = repaired.conversations.first()
    assert (row["duplicate"], row["gaps"], row["cost"], sorted(row["audit"])) == (44, 0, 44 * 4 + 3, sorted("D" * 44 + "IK"))
    assert [(r["role"], r["text"]) for r in repaired.turns.orderBy("seq", "place").collect()] == [("user", "Same."), ("assistant", "")]


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "?"), (1, 1, "assistant", " " * 300_000 + "x")]
    row = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).conversations.first()
    assert (row["blank"], row["truncated"], row["cost"], row["audit"]) == (0, 1, 3, "KK")
