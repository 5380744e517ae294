"""Repair of conversations whose turns are lost, empty, cut, repeated or given to the wrong role.

A repaired conversation has the role initials ``(s?(ua)+)?``. What may follow depends on
one of four states: nothing yet (0), after the system turn (1), after a user turn (2),
after an assistant turn (3). A row is a step between states with a cost for each pair,
and so is any run of rows. The cheapest edits, and among these the ones whose initials
come first in ASCII order, are found by divide and conquer: cost vectors over the four
states come forward from the start and backward from the end of a run, meet in its
middle, the best crossing is chosen, and both halves are solved alone. No table of the
states of all rows is kept.

Beside each cost the forward vector holds the order of the four audits behind it. Every
step ends with the letter of its row (inserts stand before it), so no audit of the same
rows is a prefix of another, and that order decides ties before any audit is written.

Rows are sorted by ranges and cut into pieces of at most ``2 ** BLOCK_BITS`` rows of one
conversation. A piece is summed up as one step, pieces of long conversations as steps
of steps; then crossings go down the same way. So no task holds a whole conversation.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphask.llm.textbytes import in_small_batches
from graphask.plans.lineage import stored
from graphask.plans.skew import find_hot_keys, salted_join

#: Rows of a piece, and pieces that one task puts together, as powers of two.
BLOCK_BITS = 12
FAN_BITS = 8
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT_SHORT = 3
STATES = range(4)
_NEVER = 1 << 60
#: Role initials that the grammar knows; any other is ``OTHER``.
ROLES = "sua"
OTHER = 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: State after a user or assistant turn is put into a state, and the inserts that end a conversation.
_NEXT = (2, 2, 3, 2)
TAIL = (0, 2, 1, 0)
_SPACES = " \t\n\x0b\x0c\r"


class Step(NamedTuple):
    """What a run of rows does: least cost and place of its audit among those of the same start, for each pair of states."""

    cost: tuple[tuple[int, ...], ...]
    rank: tuple[tuple[int, ...], ...]


def _ranked(keys: Sequence) -> tuple[int, ...]:
    order = sorted(k for k in keys if k is not None)
    return tuple(len(order) if k is None else order.index(k) for k in keys)


@functools.cache
def words(initial: int, fault: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For each pair of states the cheapest and then least edit of a row: its cost and letters, inserts first."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    extra = CUT_SHORT if fault == TRUNCATED else 0
    for start in STATES:
        here = start
        for inserts in range(3):
            paid, letters = INSERT * inserts, "I" * inserts
            options = [(here, paid + DELETE, letters + "D")]
            if fault in (FINE, TRUNCATED):
                options.append((_NEXT[here], paid + REROLE + extra, letters + "R"))
                kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((here, initial))
                if kept is not None:
                    options.append((kept, paid + KEEP + extra, letters + "K"))
            for end, cost, word in options:
                best[start][end] = min(best[start][end] or (_NEVER, ""), (cost, word))
            here = _NEXT[here]
    return tuple(map(tuple, best))


@functools.cache
def row_step(initial: int, fault: int) -> Step:
    found = words(initial, fault)
    return Step(
        tuple(tuple(w[0] if w else _NEVER for w in row) for row in found),
        tuple(_ranked([w[1] if w else None for w in row]) for row in found),
    )


def forward(steps: Sequence[Step], start: int) -> tuple[list[int], list[int]]:
    """Least costs from ``start`` to each state, and the order of the audits behind them."""
    cost, rank = [_NEVER] * 4, [0] * 4
    cost[start] = 0
    for step in steps:
        found = []
        for end in STATES:
            found.append(min((cost[p] + step.cost[p][end], rank[p], step.rank[p][end]) for p in STATES))
        cost = [min(f[0], _NEVER) for f in found]
        rank = list(_ranked([f[1:] if f[0] < _NEVER else None for f in found]))
    return cost, rank


def backward(steps: Sequence[Step], end: int) -> list[int]:
    """Least costs from each state to ``end``."""
    cost = [_NEVER] * 4
    cost[end] = 0
    for step in reversed(steps):
        cost = [min(_NEVER, min(step.cost[p][c] + cost[c] for c in STATES)) for p in STATES]
    return cost


def summed(steps: Sequence[Step]) -> Step:
    """A run of steps as one."""
    runs = [forward(steps, start) for start in STATES]
    return Step(tuple(tuple(c) for c, _ in runs), tuple(tuple(r) for _, r in runs))


def crossings(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """States before, between and after the steps on the cheapest and then audit-least way."""
    if len(steps) == 1:
        return [start, end]
    middle = len(steps) // 2
    cost, rank = forward(steps[:middle], start)
    rest = backward(steps[middle:], end)
    cross = min(STATES, key=lambda c: (cost[c] + rest[c], rank[c]))
    return crossings(steps[:middle], start, cross)[:-1] + crossings(steps[middle:], cross, end)


def last_state(steps: Sequence[Step]) -> int:
    """Where the rows of a whole conversation end; what the grammar then lacks is inserted."""
    cost, rank = forward(steps, 0)
    return min(STATES, key=lambda c: (cost[c] + INSERT * TAIL[c], rank[c]))


def _code(initial: int, fault: int) -> str:
    return chr(ord("A") + 4 * initial + fault)


_LETTERS = {_code(i, f): (i, f) for i in range(4) for f in range(4)}
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _illegal(initials: Sequence[int]) -> int:
    return sum(pair not in _LEGAL for pair in zip(initials, initials[1:], strict=False))


# A piece as a list of whole numbers: 16 costs, 16 ranks, first and last initial, illegal neighbours.


def _remembered(of_codes):
    """Results for short conversations, most of which look like many others, are kept."""
    kept = functools.lru_cache(maxsize=1 << 14)(of_codes)

    @functools.wraps(of_codes)
    def run(codes: str, *args: int):
        return (kept if len(codes) <= 32 else of_codes)(codes, *args)

    return run


@_remembered
def _piece_numbers(codes: str) -> tuple[int, ...]:
    rows = [_LETTERS[c] for c in codes]
    step = summed([row_step(*row) for row in rows])
    initials = [i for i, _ in rows]
    return (*(c for row in step.cost for c in row), *(r for row in step.rank for r in row), initials[0], initials[-1], _illegal(initials))


def _as_step(numbers: Sequence[int]) -> Step:
    def square(values: Sequence[int]) -> tuple[tuple[int, ...], ...]:
        return tuple(tuple(values[4 * p : 4 * p + 4]) for p in STATES)

    return Step(square(numbers[:16]), square(numbers[16:32]))


def _joined_numbers(children: Sequence[Sequence[int]]) -> list[int]:
    step = summed([_as_step(c) for c in children])
    between = sum((a[33], b[32]) not in _LEGAL for a, b in zip(children, children[1:], strict=False))
    illegal = between + sum(c[34] for c in children)
    return [*(c for row in step.cost for c in row), *(r for row in step.rank for r in row), children[0][32], children[-1][33], illegal]


@_remembered
def _actions(codes: str, start: int, end: int, tail: int) -> tuple[str, tuple[str, ...]]:
    """The audit of a piece, and for each of its rows what is written: ``=`` the row itself, ``U``/``A`` the row under
    another role, ``u``/``a`` an inserted turn."""
    rows = [_LETTERS[c] for c in codes]
    states = crossings([row_step(*row) for row in rows], start, end)
    audit, written = [], []
    for row, here, there in zip(rows, states, states[1:], strict=False):
        word = words(*row)[here][there][1]
        out = ""
        for letter in word:
            role = "a" if here == 2 else "u"
            out += {"I": role, "R": role.upper(), "K": "=", "D": ""}[letter]
            here = _NEXT[here] if letter == "I" else here
        audit.append(word)
        written.append(out)
    here = end
    for _ in range(tail):
        written[-1] += "a" if here == 2 else "u"
        here = _NEXT[here]
    return "".join(audit) + "I" * tail, tuple(written)


def _mapped(rows: DataFrame, run_row, schema: str) -> DataFrame:
    """Rows made of rows: ``run_row`` gives a list of tuples for each."""
    names = [part.split(":")[0].strip() for part in schema.split(";")]
    spark_schema = schema.replace(";", ",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [out for row in batch.to_pylist() for out in run_row(row)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, out, strict=True)) for out in made], types)

    types = to_arrow_schema(T.StructType.fromDDL(spark_schema))
    return rows.mapInArrow(run, spark_schema)


def _piece_ways(pieces: DataFrame, fan_bits: int) -> DataFrame:
    """``conv, block, start, end, tail, cost, illegal`` of pieces ``conv, block, numbers``.

    ``cost`` and ``illegal`` are those of the whole conversation on its first piece and
    zero on the others. Conversations of more than ``2 ** fan_bits`` pieces are summed up
    by runs of pieces first.
    """
    made = "conv: string; block: long; start: int; end: int; tail: int; cost: long; illegal: long"

    def collected(nodes: DataFrame, keys: list[str]) -> DataFrame:
        children = F.sort_array(F.collect_list(F.struct("block", "numbers"))).alias("children")
        return nodes.groupBy(*keys).agg(children)

    def ways(row: dict, start: int, end: int, tail: int, cost: int, illegal: int) -> list[tuple]:
        children = row["children"]
        states = crossings([_as_step(c["numbers"]) for c in children], start, end)
        last = len(children) - 1
        return [
            (row["conv"], c["block"], states[i], states[i + 1], tail if i == last else 0, 0 if i else cost, 0 if i else illegal)
            for i, c in enumerate(children)
        ]

    def from_root(row: dict) -> list[tuple]:
        numbers = [c["numbers"] for c in row["children"]]
        steps = [_as_step(n) for n in numbers]
        end = last_state(steps)
        cost = forward(steps, 0)[0][end] + INSERT * TAIL[end]
        return ways(row, 0, end, TAIL[end], cost, _joined_numbers(numbers)[34])

    most = pieces.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    if most <= 1 << fan_bits:
        return _mapped(collected(pieces, ["conv"]), from_root, made)
    runs = stored(collected(pieces.withColumn("run", F.shiftright("block", fan_bits)), ["conv", "run"]), "conversation-runs")

    def one(row: dict) -> list[tuple]:
        return [(row["conv"], row["run"], _joined_numbers([c["numbers"] for c in row["children"]]))]

    above = stored(_mapped(runs, one, "conv: string; block: long; numbers: array<long>"), "conversation-runs")
    found = _piece_ways(above, fan_bits).withColumnRenamed("block", "run")

    def from_above(row: dict) -> list[tuple]:
        return ways(row, row["start"], row["end"], row["tail"], row["cost"], row["illegal"])

    return _mapped(runs.join(found, ["conv", "run"]), from_above, made)


def _named(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("none"))


def _ordered(conversations: DataFrame) -> DataFrame:
    """The rows with ``seq``, which orders them by conversation and turn (missing turns first), then in a fixed way."""
    rows = conversations.select(
        _named().alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    # Ranges are told by the start and a hash of a text, so that no whole text is sampled, and cut between equal rows.
    order = ["conv", "turn", "role", F.substring("text", 1, 32), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "text")
    return stored(ordered.withColumn("seq", F.monotonically_increasing_id()), "conversation-rows")


def _coded(rows: DataFrame) -> DataFrame:
    """``conv, seq, turn, initial, fault`` of ordered rows."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = sum((F.when(F.substring("role", 1, 1) == r, i - OTHER).otherwise(0) for i, r in enumerate(ROLES)), F.lit(OTHER))
    whole = F.concat_ws(":", "conv", F.octet_length("role"), "role", "text")
    marks = rows.select(
        "conv",
        "seq",
        "turn",
        initial.alias("initial"),
        (bare == "").alias("is_blank"),
        F.substring(bare, -1, 1).isin(".", "!", "?").alias("ends"),
        F.sha2(whole, 256).alias("same"),
    )
    # Only texts that occur again are joined; the first of them is no duplicate.
    firsts = stored(
        marks.where("NOT is_blank").groupBy("same").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "conversation-repeats",
    )
    hot = find_hot_keys(firsts, ["same"])
    fault = (
        F.when(F.col("is_blank"), BLANK)
        .when(F.col("first").isNotNull() & (F.col("seq") > F.col("first")), DUPLICATE)
        .when(~F.col("ends"), TRUNCATED)
        .otherwise(FINE)
    )
    joined = salted_join(marks, firsts.select("same", "first"), ["same"], hot, "seq", "left")
    return joined.select("conv", "seq", "turn", "initial", fault.alias("fault"))


class Repaired(NamedTuple):
    """``conversations``: a row of measures and the audit for each; ``turns``: ``conv_id, seq, place, role, text`` of what is left."""

    conversations: DataFrame
    turns: DataFrame


def repair(conversations: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> Repaired:
    """Repair every conversation of ``conv_id, turn, role, text``.

    A missing role or text is one space, rows of a missing ``conv_id`` are one
    conversation, missing turns come first, rows of the same turn follow in the order of
    role, the first 32 characters of the text and a hash. The first fault of a row counts: blank, the same role and text
    earlier in the conversation, or no ``. ! ?`` at its end. Keeping a row costs 0,
    another role 3, deletion 4 (blank rows and duplicates must go), an inserted empty
    turn 3, keeping a truncated text 3 more. Other columns are ignored; no rows give no
    conversations. ``gaps, blank, duplicate, truncated, illegal, cost`` are whole
    numbers, ``audit`` the initials of the edits in order; ``conv`` names a
    conversation, also one without an id.
    """
    rows = _ordered(conversations)
    coded = stored(_coded(rows), "conversation-faults")
    letter = F.char(F.lit(ord("A")) + 4 * F.col("initial") + F.col("fault"))
    in_order = F.sort_array(F.collect_list(F.struct("seq", letter.alias("letter"))))
    pieces = coded.groupBy("conv", F.shiftright("seq", block_bits).alias("block")).agg(in_order.alias("rows"))
    pieces = pieces.select(
        "conv", "block", F.col("rows")[0]["seq"].alias("first"), F.array_join(F.col("rows")["letter"], "").alias("codes")
    )

    def summary(row: dict) -> list[tuple]:
        return [(row["conv"], row["block"], row["first"], row["codes"], list(_piece_numbers(row["codes"])))]

    made = "conv: string; block: long; first: long; codes: string; numbers: array<long>"
    pieces = stored(_mapped(pieces, summary, made), "conversation-pieces")
    ways = _piece_ways(pieces.select("conv", "block", "numbers"), fan_bits)

    def solve(row: dict) -> list[tuple]:
        audit, written = _actions(row["codes"], row["start"], row["end"], row["tail"])
        return [(row["conv"], row["block"], row["first"], row["cost"], row["illegal"], audit, list(written))]

    made = "conv: string; block: long; first: long; cost: long; illegal: long; audit: string; written: array<string>"
    solved = stored(_mapped(pieces.drop("numbers").join(ways, ["conv", "block"]), solve, made), "conversation-audits")

    audit = F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"], "")
    audits = solved.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), audit.alias("audit"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    faults = coded.groupBy("conv").agg(
        gaps.alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))),
    )
    measures = faults.join(audits, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = solved.select("first", F.posexplode("written").alias("i", "edit"))
    edits = edits.where("edit <> ''").select((F.col("first") + F.col("i")).alias("seq"), "edit")
    kept = rows.select("seq", "conv", "role", "text").join(edits, "seq")
    own = F.col("edit").isin("=", "U", "A")
    turns = kept.select("conv", "seq", "role", "text", F.posexplode(F.split("edit", "")).alias("place", "edit"))
    turns = turns.where("edit <> ''").select(
        "conv",
        "seq",
        "place",
        F.when(F.col("edit") == "=", F.col("role"))
        .when(F.upper("edit") == "U", "user")
        .otherwise("assistant")
        .alias("role"),
        F.when(own, F.col("text")).otherwise("").alias("text"),
    )
    return Repaired(measures, turns)


def _text_hashes(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of the lines ``role:text`` of each conversation, read in order without holding them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield _pairs(done)
        if digest is not None:
            yield _pairs([(now, digest.hexdigest())])

    lines = turns.select("conv", "seq", "place", F.concat_ws(":", "role", "text").alias("line"))
    in_order = lines.repartition("conv").sortWithinPartitions("conv", "seq", "place").select("conv", "line")
    return in_small_batches(in_order).mapInArrow(run, "conv string, repaired_sha256 string")


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in rows], pa.string()), pa.array([h for _, h in rows], pa.string())], ["conv", "repaired_sha256"]
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults made by the checksum of ``conv_id:turn``: lost, emptied, cut, repeated or given to the user.

    Every missing value is one space in the checksum, a missing role or text is one space.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat_ws(":", spaced["conv_id"], spaced["turn"])) % 20
    rows = conversations.select("conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    rows = rows.where("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Damage, repair and measure: a row for each ``conv_id``, also for conversations that lost all rows.

    These have zeros, an empty audit and the checksum of the empty string, as have
    conversations of which nothing is left after the repair (but for their measures).
    """
    repaired = repair(damaged(conversations))
    ids = conversations.select("conv_id").distinct().withColumn("conv", _named())
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = ids.join(repaired.conversations, "conv", "left").join(_text_hashes(repaired.turns), "conv", "left")
    return joined.select(
        "conv_id",
        *(F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
