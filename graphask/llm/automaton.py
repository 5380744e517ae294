"""Finite automata over bytes: regexes to transition arrays by subset construction and minimisation.

The regexes are ASCII: characters, ``\\xHH`` and escaped marks, classes with ranges,
groups, ``|`` and the repetitions ``? * + {m} {m,} {m,n}``. Several rules share one
automaton, whose states say which rules accept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: A parsed regex: ("set", bytes), ("cat", parts), ("alt", parts) or ("rep", part, least, most or None).
Node = tuple


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern, 0, any_case

    def peek(self, ahead: str) -> bool:
        return self.text.startswith(ahead, self.at)

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> Node:
        parts = [self.sequence()]
        while self.peek("|"):
            self.at += 1
            parts.append(self.sequence())
        return ("alt", parts)

    def sequence(self) -> Node:
        parts: list[Node] = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node: Node) -> Node:
        while self.at < len(self.text) and self.text[self.at] in "?*+{":
            mark = self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(mark, (0, 0))
            if mark == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                least = int(low)
                most = least if not comma else int(high) if high else None
                self.at = end + 1
            node = ("rep", node, least, most)
        return node

    def atom(self) -> Node:
        if self.peek("("):
            self.at += 3 if self.peek("(?:") else 1
            node = self.alternatives()
            self.at += 1
            return node
        if self.peek("["):
            self.at += 1
            chosen: set[int] = set()
            while not self.peek("]"):
                low = self.character()
                high = low
                if self.peek("-") and not self.peek("-]"):
                    self.at += 1
                    high = self.character()
                chosen |= set(range(low, high + 1))
            self.at += 1
        else:
            chosen = {self.character()}
        if self.any_case:
            chosen |= {ord(chr(c).swapcase()) for c in chosen if chr(c).isalpha()}
        return ("set", frozenset(chosen))

    def character(self) -> int:
        letter = self.take()
        if letter == "\\":
            letter = self.take()
            if letter == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if letter.isalnum():
                raise ValueError(f"unknown escape \\{letter}")
        if not letter.isascii():
            raise ValueError("rules are ASCII")
        return ord(letter)


def parse(pattern: str, any_case: bool = False) -> Node:
    parser = _Parser(pattern, any_case)
    node = parser.alternatives()
    if parser.at != len(pattern):
        raise ValueError(f"cannot read {pattern!r} at {parser.at}")
    return node


def reversed_node(node: Node) -> Node:
    """The regex of all matches read backwards."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", reversed_node(node[1]), *node[2:])
    parts = [reversed_node(p) for p in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    """States with byte sets to a next state, and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def build(self, node: Node, start: int) -> int:
        """Add ``node`` after ``start``; the state in which it has matched."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(part, first)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[loop].append(end)
            self.empty[self.build(part, loop)].append(loop)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.build(part, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for following in self.empty[todo.pop()]:
                if following not in seen:
                    seen.add(following)
                    todo.append(following)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """A minimal deterministic automaton; state 0 is where it starts.

    ``step[state, kind_of[byte]]`` is the next state and ``accepts[state]`` a bit for
    each rule that has matched there. A state from which nothing can match any more is
    ``dead`` (-1 if there is none).
    """

    kind_of: np.ndarray
    step: np.ndarray
    accepts: np.ndarray
    dead: int

    def synchronising(self) -> np.ndarray:
        """For each byte, whether it leads to one state from wherever it is read."""
        return (self.step == self.step[:1]).all(axis=0)[self.kind_of]


def compiled(nodes: Sequence[Node], anywhere: bool) -> Automaton:
    """One automaton for all rules; with ``anywhere`` a match may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    final: dict[int, int] = {}
    for rule, node in enumerate(nodes):
        first = nfa.state()
        nfa.empty[start].append(first)
        final[nfa.build(node, first)] = rule
    # Bytes that no rule tells apart are one kind.
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    member = np.array([[b in s for b in range(256)] for s in sets], dtype=bool).reshape(len(sets), 256)
    _, first_of, kind_of = np.unique(member, axis=1, return_index=True, return_inverse=True)
    kind_of = kind_of.ravel()
    kinds_in = {s: np.flatnonzero(member[i][first_of]).tolist() for i, s in enumerate(sets)}

    begin = nfa.closure([start])
    number, todo, rows = {begin: 0}, [begin], []
    while todo:
        current = todo.pop()
        targets: list[set[int]] = [set() for _ in first_of]
        for state in current:
            for chosen, target in nfa.moves[state]:
                for kind in kinds_in[chosen]:
                    targets[kind].add(target)
        row = []
        for target in targets:
            following = nfa.closure(target)
            following = following | begin if anywhere else following
            if following not in number:
                number[following] = len(number)
                todo.append(following)
            row.append(number[following])
        rows.append((number[current], row))
    step = np.array([row for _, row in sorted(rows)], dtype=np.int64)
    accepts = np.zeros(len(number), dtype=np.int64)
    for states, at in number.items():
        for state in states & final.keys():
            accepts[at] |= 1 << final[state]
    return _minimal(kind_of, step, accepts)


def _minimal(kind_of: np.ndarray, step: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merge states that no continuation tells apart, by refining the partition until it stays."""
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        told = np.unique(np.c_[group, group[step]], axis=0, return_inverse=True)[1].ravel()
        if told.max() == group.max():
            break
        group = told
    order = np.unique(group, return_index=True)[1]
    place = np.argsort(np.r_[np.flatnonzero(order == order[group[0]]), np.flatnonzero(order != order[group[0]])])
    group = place[group]
    first = np.unique(group, return_index=True)[1]
    step, accepts = group[step[first]], accepts[first]
    dead = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(kind_of, step.astype(np.int32), accepts, int(dead[0]) if len(dead) else -1)
