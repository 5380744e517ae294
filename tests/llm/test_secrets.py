"""The secret scan against Python's regex engine, and its automaton against words taken one by one."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphask.llm.automaton import compiled, parse, reversed_node
from graphask.llm.secret_scan import BASE_RULES, FEW, RULES, Rule, find_secrets, scanner, secret_digest
from graphask.llm.textbytes import buffers

PIECES = (
    ["password", "PassWD", "token", "secret", "api_key", "APIKEY", " ", "  ", "=", ":", '"', "'", "\n", "\t", "é", "\U0001f600", ","]
    + ["AKIA", "0123456789abcdef", "ABCDEF0123456789", "deadbeef", "x", "-", ".", "ghp_", "gho_" + "a1B2" * 9, "xoxb-", "AIza", "Z" * 35]
    + ["eyJ", "eyJhbGciOi.eyJzdWIi.c2lnbmF0dXJl", "://", "@", "user:pw", "http", "bearer ", "Bearer ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----"]
)


def _text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))


def _spans(text, rules=RULES):
    """Matches one rule after the other, in code points."""
    out = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text, (re.IGNORECASE if rule.any_case else 0) | re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), place, f"{rule.kind}:{m.start()}:{m.end()}"))
    return [(rules[place].kind, span) for _, place, span in sorted(out)]


@pytest.mark.parametrize(
    "pattern", ["a", "ab|cd", "a+b?", "(ab)*c", "a{2}", "a{2,3}b", "[a-c]{2,}d", "x?(a|ba)+[b-d]", "\\x61\\+", "[]a]|[+-]", "a{0,2}c"]
)
def test_automaton_accepts_what_the_regex_matches(pattern):
    pattern = pattern.replace("[]a]", "[a]")
    forward, backward = (compiled([n], anywhere=False) for n in (parse(pattern), reversed_node(parse(pattern))))

    def accepts(automaton, word):
        state = 0
        for byte in word.encode():
            state = automaton.step[state, automaton.kind_of[byte]]
        return bool(automaton.accepts[state])

    for size in range(5):
        for word in map("".join, itertools.product("abcd+-x", repeat=size)):
            want = re.fullmatch(pattern, word) is not None
            assert accepts(forward, word) == want and accepts(backward, word[::-1]) == want, word


def test_automaton_is_minimal_and_tells_rules_apart():
    automaton = compiled([parse("ab"), parse("b"), parse("b")], anywhere=True)
    state, bits = 0, []
    for byte in b"aabb":
        state = automaton.step[state, automaton.kind_of[byte]]
        bits.append(int(automaton.accepts[state]))
    assert bits == [0, 0, 7, 6] and len(automaton.step) == 4
    assert len(compiled([parse("(a|b|c)(x|y)")], anywhere=False).step) == len(compiled([parse("[a-c][xy]")], anywhere=False).step)


def test_unreadable_rules_are_refused():
    for bad in ("a)", "\\d", "é"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        scanner((Rule("empty", "a*"),))


@pytest.mark.parametrize("repeat", [1, 3 * FEW])
def test_spans_equal_those_of_the_regex_engine(repeat):
    rng = random.Random(repeat)
    texts = [_text(rng) for _ in range(300)]
    texts += ["token=a secret=abcdefgh", "secret: token: abcdef", "f" * 2_000, "AKIA" * 9, "password = '" + "k" * 2_000, "a" * 23 + "g" + "a" * 24]
    data, ends = buffers(pa.array(texts * repeat))
    got = scanner(RULES).spans(data, ends[1:])
    want = []
    for begin, text in zip(ends, texts * repeat, strict=False):
        raw = text.encode()
        for place, rule in enumerate(RULES):
            for m in re.finditer(rule.pattern.encode(), raw, re.IGNORECASE if rule.any_case else 0):
                if len(m.group(rule.group)) >= rule.least:
                    want.append((place, int(begin) + m.start(), int(begin) + m.end()))
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_digest_in_code_points(spark):
    rng = random.Random(7)
    texts = {i: _text(rng) for i in range(200)} | {900: None, 901: "", 902: "é😀 token: abcdef, é AKIA" + "A1" * 9 + " " + "0f" * 20}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, spans string, start int")
    rows = {r["doc_id"]: r for r in secret_digest(docs).collect()}
    base = {rule.kind for rule in BASE_RULES}
    for i, text in texts.items():
        spans = _spans(text or "")
        of_base = [s for kind, s in spans if kind in base]
        assert rows[i]["spans"] == ",".join(s for _, s in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(of_base).encode()).hexdigest()
        for kind in base:
            assert rows[i][f"n_{kind}"] == sum(k == kind for k, _ in spans)
    assert rows[902]["spans"].startswith("assign:3:16,access:20:42")


def test_other_rules(spark):
    docs = spark.createDataFrame([(1, "call 555-1234 or 555-12"), (1, "call 555-1234 or 555-12"), (None, "555-0000")], "doc_id long, text string")
    found = find_secrets(docs, [Rule("phone", "[0-9]{3}-[0-9]{4}")]).collect()
    spans = sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]]) for r in found)
    assert spans == [("1", [("phone", 5, 13)]), ("1", [("phone", 5, 13)]), ("None", [("phone", 0, 8)])]


def test_marks_do_not_depend_on_how_stretches_are_read(monkeypatch):
    rng = random.Random(2)
    data, ends = buffers(pa.array([_text(rng) for _ in range(200)]))
    scan = scanner(RULES)
    together = scan.marked(data, ends[1:])
    monkeypatch.setattr("graphask.llm.secret_scan.FEW", 10**9)
    alone = scan.marked(data, ends[1:])
    assert np.array_equal(together[0], alone[0]) and np.array_equal(together[1], alone[1])
