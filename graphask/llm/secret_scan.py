"""Secrets in texts by one deterministic automaton for all rules.

The regexes of all rules, read backwards, are compiled into one minimal automaton. A
single pass over the bytes of a text, from its end to its start, tells for each byte
which rules have a match that starts there. The pass runs over many stretches at once:
a stretch ends at a byte that leads to one state from wherever it is read (a line break,
most marks) or at the end of a text. Where a rule starts, its own automaton reads on to
the longest match; the next match of the rule begins after it. A match counts if its
value is long enough.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphask.llm.automaton import Automaton, compiled, parse, reversed_node
from graphask.llm.textbytes import PIECE, buffers, in_small_batches


class Rule(NamedTuple):
    """A kind of secret: an ASCII regex, the group (0: all) that must have ``least`` characters, and whether case counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


# The three rules whose spans are counted apart. Of runs of hexadecimal
# digits only those of 24 and more are matches at all, which are the same runs.
BASE_RULES = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}", least=24),
)
# Public token formats.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=30),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("url", "[A-Za-z]+://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@"),
    Rule("bearer", "bearer [A-Za-z0-9._~+/=-]+", least=27, any_case=True),
)
RULES = BASE_RULES + MORE_RULES
#: Stretches read side by side; fewer are read one by one.
FEW = 64


class Scanner:
    """The automata of a set of rules."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        nodes = [parse(rule.pattern, rule.any_case) for rule in rules]
        self.starts = compiled([reversed_node(node) for node in nodes], anywhere=True)
        self.ends = [compiled([node], anywhere=False) for node in nodes]
        self.exact = [re.compile(rule.pattern.encode(), re.IGNORECASE if rule.any_case else 0) for rule in rules]
        self.cuts = self.starts.synchronising()
        if self.starts.accepts[0]:
            raise ValueError("a rule matches the empty text")

    def marked(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes at which some rule has a match that starts there, in order, and the bits of these rules.

        ``bounds`` are the ends of the texts that lie one after the other, from 0 on.
        """
        automaton = self.starts
        n_kinds = automaton.step.shape[1]
        table = (automaton.step * n_kinds).ravel()
        kinds = automaton.kind_of.astype(np.int32)
        accepting = np.repeat(automaton.accepts, n_kinds)
        hits = accepting != 0
        hi = np.unique(np.r_[np.flatnonzero(self.cuts[data]) + 1, bounds])
        hi = hi[hi > 0]
        size = np.diff(np.r_[0, hi])
        order = np.argsort(-size, kind="stable")
        last, size = hi[order] - 1, size[order]
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        state = np.zeros(len(last), dtype=np.int32)
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        done = 0
        for done, n in enumerate(live.tolist()):
            if n < FEW:
                break
            here = last[:n] - done
            state = table[state[:n] + kinds[data[here]]]
            hit = np.flatnonzero(hits[state])
            if len(hit):
                at.append(here[hit])
                found.append(accepting[state[hit]])
        else:
            done = len(live)
        text, step, kind_of, accepts = None, None, None, None
        for lane in range(int(live[done]) if done < len(live) else 0):
            if text is None:
                text, kind_of = data.tobytes(), kinds.tolist()
                step, accepts = table.tolist(), accepting.tolist()
            now, stop = int(state[lane]), int(last[lane] - size[lane])
            for place in range(int(last[lane]) - done, stop, -1):
                now = step[now + kind_of[text[place]]]
                if accepts[now]:
                    at.append(np.array([place]))
                    found.append(np.array([accepts[now]]))
        places, bits = np.concatenate(at), np.concatenate(found)
        order = np.argsort(places, kind="stable")
        return places[order], bits[order]

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """``(rule number, start, end)`` of the matches that count, in bytes."""
        places, bits = self.marked(data, bounds)
        out = []
        text = data.tobytes() if len(places) else b""
        for number, rule in enumerate(self.rules):
            starts = places[(bits >> number & 1).astype(bool)]
            free = 0
            while free < len(starts):
                start = int(starts[free])
                stop = int(bounds[np.searchsorted(bounds, start, "right")])
                end = _longest(self.ends[number], text, start, stop)
                match = self.exact[number].fullmatch(text, start, end)
                if len(match.group(rule.group)) >= rule.least:
                    out.append((number, start, end))
                free = int(np.searchsorted(starts, end, "left"))
        return out


def _longest(automaton: Automaton, text: bytes, start: int, stop: int) -> int:
    """End of the longest match that starts at ``start``."""
    state, end = 0, start
    for place in range(start, stop):
        state = automaton.step[state, automaton.kind_of[text[place]]]
        if state == automaton.dead:
            break
        if automaton.accepts[state]:
            end = place + 1
    return end


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once on the driver; the arrays, whose size depends on the rules only, travel with the tasks."""
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id, spans`` of every document ``doc_id, text``.

    ``spans`` is an array of ``kind, start, end`` in code points, ordered by start, then
    by the order of the rules. Matches of one rule are leftmost, longest and do not
    overlap; those of different rules may. A match whose value is too short is no span
    but is passed over. A missing or empty text has no spans; repeated rows and rows
    without an id come out as often as they come in; no documents give no rows; other
    columns are ignored. Texts of any length are read whole, about ``PIECE`` bytes of
    several texts at a time.
    """
    rules = tuple(rules)
    kinds = [rule.kind for rule in rules]
    scan = scanner(rules)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = buffers(batch.column("_whole_text"))
            first, spans = 0, []
            while first < batch.num_rows:
                upto = int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1
                upto = min(max(upto, first + 1), batch.num_rows)
                spans += _of_piece(scan, data[ends[first] : ends[upto]], ends[first : upto + 1] - ends[first], kinds)
                first = upto
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("_whole_text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>"
    return in_small_batches(texts).mapInArrow(run, schema)


def _of_piece(scan: Scanner, data: np.ndarray, bounds: np.ndarray, kinds: list[str]) -> list[list[dict]]:
    spans: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    found = scan.spans(data, bounds[1:])
    if found:
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        for number, start, end in sorted(found, key=lambda x: (x[1], x[0])):
            doc = int(np.searchsorted(bounds, start, "right")) - 1
            before = points[bounds[doc]]
            spans[doc].append({"kind": kinds[number], "start": int(points[start] - before), "end": int(points[end] - before)})
    return spans


def _joined(spans: Column) -> Column:
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base rules, a checksum of their spans, and all spans as text, from :func:`find_secrets`.

    A text without secrets, an empty and a missing one have zero counts, no spans and the
    checksum of the empty string; rows are those of :func:`find_secrets`.
    """
    base = [rule.kind for rule in BASE_RULES]

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return find_secrets(docs).select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
