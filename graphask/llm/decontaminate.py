"""Benchmark items in documents, also with other numbers, names and units.

Words become template tokens: numbers, names and units turn into typed placeholders,
all else stays, in lower case and without marks at its ends. Windows of template tokens,
the longer the more placeholders they hold, are joined by hash; the values that stood behind the placeholders must then map
consistently from the item to the document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphask.llm.hashed_text import bare, map_texts
from graphask.llm.textbytes import Words, mixed
from graphask.plans.lineage import stored

WINDOW = 8
#: Tokens of a template window that are not placeholders; the window is extended until it has them. Texts of fewer
#: tokens than ``WINDOW``, but this many, are one window as a whole.
LEAST_WORDS = 4
#: Share of an item's windows of a form that a document must have, and of placeholders that may contradict each other.
LEAST_SHARE = 0.5
MOST_CONFLICTS = 0.2
#: Up to this many item windows are looked up in the tasks; more are joined by a shuffle.
MAX_LOOKUP = 1_000_000

# Words that count as numbers and units.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound "
    "pounds oz ounce ounces ton tons ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents "
    "percent degree degrees mph kmh km/h m/s hz khz mhz v w kw kwh j kj cal kcal byte bytes kb mb gb tb"
).split()

_NUMBER, _NAME, _UNIT = np.uint64(11), np.uint64(22), np.uint64(33)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?:;")] = True


def _hashes_of(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    flat = np.frombuffer(data, dtype=np.uint8)
    return np.sort(Words(flat, starts, ends, np.zeros(len(words), np.int64), 0, 1).hashes())


_NUMBER_HASHES, _UNIT_HASHES = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)


@dataclass(frozen=True)
class Windows:
    """Windows of template tokens: owner, place of the first token, form, hash, and the values behind its placeholders."""

    doc: np.ndarray
    place: np.ndarray
    template: np.ndarray
    hash: np.ndarray
    values: np.ndarray
    per_doc: np.ndarray
    templates_per_doc: np.ndarray
    tokens_per_doc: np.ndarray


def template_windows(words: Words, wanted: np.ndarray | None = None, short: tuple[int, ...] | None = None) -> Windows:
    """All windows as templates, extended until they have enough plain words, those with placeholders also as plain words.

    With ``short``, also all windows of these sizes below ``WINDOW``; without, those that are a whole text.
    With ``wanted``, sorted hashes, only windows with one of these. ``values`` has a row
    per window, for its first and its last ``WINDOW`` tokens: the hash of the word behind a
    placeholder, 0 for plain words. ``per_doc`` and ``templates_per_doc`` count the places
    of a window of any form and of a template in each document.
    """
    plain = bare(words)
    value = plain.hashes()
    n = len(value)
    starts, lo, hi = np.zeros(n, dtype=bool), plain.start, plain.end
    raw = words.data
    if n:
        lines = np.r_[0, np.cumsum(raw == 10)]
        after_end = _ENDS[raw[np.minimum(hi[:-1], len(raw) - 1)]]
        starts[0] = True
        starts[1:] = (plain.doc[1:] != plain.doc[:-1]) | after_end | (lines[lo[1:]] > lines[hi[:-1]])
    digits = np.r_[0, np.cumsum((raw >= 48) & (raw < 58))]
    number = (digits[hi] > digits[lo]) | np.isin(value, _NUMBER_HASHES)
    first = raw[lo]
    second = raw[np.minimum(lo + 1, len(raw) - 1)] if n else first
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second < 0x9F))
    unit = np.zeros(n, dtype=bool)
    unit[1:] = number[:-1] & np.isin(value[1:], _UNIT_HASHES) & (plain.doc[1:] == plain.doc[:-1])
    lower = ((second >= 97) & (second <= 122)) | (second >= 0x80)
    name = capital & lower & ~starts & ~number & ~unit
    token = np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], mixed(value))
    filled = number | unit | name

    count = max(n - WINDOW + 1, 0)
    begin = np.arange(count)
    inside = plain.doc[:count] == plain.doc[WINDOW - 1 : WINDOW - 1 + count]
    slots = np.r_[0, np.cumsum(filled)]
    slots = slots[WINDOW : WINDOW + count] - slots[:count]
    words_at = np.flatnonzero(~filled)
    enough = np.r_[words_at[LEAST_WORDS - 1 :], np.full(LEAST_WORDS, n)] if len(words_at) >= LEAST_WORDS else np.full(len(words_at) + 1, n)
    extended = np.maximum(begin + WINDOW, enough[np.searchsorted(words_at, begin)] + 1)
    whole = extended <= n
    whole[whole] = plain.doc[begin[whole]] == plain.doc[extended[whole] - 1]
    values = np.where(filled, value, np.uint64(0))
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, _STEP)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n, _UNSTEP)])
    whole_begin, whole_end = begin[whole], extended[whole]
    plain_begin = begin[inside & (slots > 0)]
    plain_end = plain_begin + WINDOW
    n_whole, n_inside = plain.doc[whole_begin], plain.doc[:count][inside]
    filled_upto = np.r_[0, np.cumsum(filled)]
    size_of = np.bincount(plain.doc, minlength=words.n_docs)
    for size in range(LEAST_WORDS, WINDOW) if short is None else short:
        at = np.arange(max(n - size + 1, 0))
        at = at[plain.doc[at] == plain.doc[at + size - 1]]
        if short is None:
            at = at[size_of[plain.doc[at]] == size]
        holes = filled_upto[at + size] - filled_upto[at]
        enough_words = at[size - holes >= LEAST_WORDS]
        whole_begin, whole_end = np.r_[whole_begin, enough_words], np.r_[whole_end, enough_words + size]
        plain_begin, plain_end = np.r_[plain_begin, at[holes > 0]], np.r_[plain_end, at[holes > 0] + size]
        if short is None:
            n_whole, n_inside = np.r_[n_whole, plain.doc[enough_words]], np.r_[n_inside, plain.doc[at]]
    found = []
    # The words themselves where a window has placeholders, too: names that capitals or sentence starts hide still match.
    for tokens, slot_values, at, end in (
        (token, values, whole_begin, whole_end),
        (mixed(value), np.zeros_like(values), plain_begin, plain_end),
    ):
        upto = np.r_[np.uint64(0), np.cumsum(tokens * power[:n])]
        hashed = mixed((upto[end] - upto[at]) * back[at])
        if wanted is not None:
            low = np.uint64((1 << 20) - 1)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[wanted & low] = True
            kept = np.flatnonzero(seen[hashed & low])
            kept = kept[np.isin(hashed[kept], wanted)]
            at, end, hashed = at[kept], end[kept], hashed[kept]
        heads = np.minimum(at[:, None] + np.arange(WINDOW), end[:, None] - 1)
        tails = np.maximum(end[:, None] - np.arange(WINDOW, 0, -1), at[:, None])
        inner = np.concatenate([heads, tails], axis=1)
        found.append((at, hashed, slot_values[inner], np.full(len(at), not found)))
    at = np.concatenate([f[0] for f in found])
    order = np.argsort(at, kind="stable")
    at = at[order]
    first_word = np.searchsorted(plain.doc, np.arange(words.n_docs))
    return Windows(
        plain.doc[at],
        at - first_word[plain.doc[at]],
        np.concatenate([f[3] for f in found])[order],
        np.concatenate([f[1] for f in found])[order],
        np.concatenate([f[2] for f in found])[order],
        np.bincount(n_inside, minlength=words.n_docs),
        np.bincount(n_whole, minlength=words.n_docs),
        size_of,
    )


_LISTS = T.StructType([
    T.StructField("n_windows", T.LongType()),
    T.StructField("n_templates", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("forms", T.ArrayType(T.BooleanType())),
    T.StructField("places", T.ArrayType(T.LongType())),
    T.StructField("hashes", T.ArrayType(T.LongType())),
    T.StructField("values", T.ArrayType(T.ArrayType(T.LongType()))),
])


def _windows(
    texts: DataFrame, columns: list[str], wanted: np.ndarray | None = None, short: tuple[int, ...] | None = None
) -> DataFrame:
    """One row per window: ``columns, n_windows, n_templates, n_tokens, template, place, hash, slots``."""

    def per_piece(words: Words) -> list:
        found = template_windows(words, wanted, short)
        ends = pa.array(np.searchsorted(found.doc, np.arange(words.n_docs + 1)).astype(np.int32))
        rows = pa.array(np.arange(0, found.values.size + 1, 2 * WINDOW, dtype=np.int32))
        values = pa.ListArray.from_arrays(rows, pa.array(found.values.ravel().astype(np.int64)))
        lists = (pa.array(found.template), pa.array(found.place), pa.array(found.hash.astype(np.int64)), values)
        counts = (found.per_doc.astype(np.int64), found.templates_per_doc.astype(np.int64), found.tokens_per_doc.astype(np.int64))
        return [*counts, *(pa.ListArray.from_arrays(ends, column) for column in lists)]

    listed = map_texts(texts, columns, _LISTS, per_piece).where(F.size("hashes") > 0)
    each = F.explode(F.arrays_zip(
        F.col("forms").alias("template"), F.col("places").alias("place"), F.col("hashes").alias("hash"), F.col("values").alias("slots")
    ))
    counts = ["n_windows", "n_templates", "n_tokens"]
    return listed.select(*columns, *counts, each.alias("w")).select(
        *columns, *counts, F.col("w.template").alias("template"), F.col("w.place").alias("place"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("slots")
    )


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, row_key, item_id, n_windows, n_matched, n_slots, n_conflicts`` of documents that hold an item.

    A document holds an item if it has ``LEAST_SHARE`` of the item's windows, or of its
    templates. Windows
    with the same distance between their places in both texts are one occurrence; an
    occurrence counts only if few of its placeholders contradict each other, that is,
    one value of the item stands for two values of the document or two for one.

    Whole texts are read in their partitions, and only windows that an item has leave
    them while the item windows are within ``MAX_LOOKUP``; beyond, all windows meet in
    the same join by a shuffle. Later groups are per document and item. Missing texts
    have no windows. An item of fewer than ``WINDOW`` words is one window as a whole, and windows of its size are
    made of all documents; items of fewer than ``LEAST_WORDS`` words are not found. Documents
    with equal ids are told apart by ``row_key``, a hash of id and text; repeated rows
    are reported once. Empty tables give no rows; other columns are ignored.
    """
    items = stored(
        _windows(benchmark.select("item_id", "text").distinct(), ["item_id"]).select(
            "item_id",
            F.col("n_windows").alias("item_windows"),
            F.col("n_templates").alias("item_templates"),
            F.col("n_tokens").alias("item_tokens"),
            F.col("place").alias("item_place"),
            "hash",
            F.col("slots").alias("item_slots"),
        ),
        "leak-items",
    )
    small = items.count() <= MAX_LOOKUP
    wanted = None
    if small:
        hashes = [row["hash"] for row in items.select("hash").distinct().collect()]
        wanted = np.sort(np.array(hashes, dtype=np.int64).astype(np.uint64))
    short = tuple(row["item_tokens"] for row in items.where(F.col("item_tokens") < WINDOW).select("item_tokens").distinct().collect())
    items = items.drop("item_tokens")
    keyed = docs.select("doc_id", "text", row_key(docs).alias("row_key"))
    found = _windows(keyed, ["doc_id", "row_key"], wanted, short).drop("n_windows", "n_templates", "n_tokens")
    hits = found.join(F.broadcast(items) if small else items, "hash").distinct()
    pair = ["doc_id", "row_key", "item_id", "item_windows", "item_templates"]
    occurrence = [*pair, "shift"]
    placed = hits.withColumn("shift", F.col("place") - F.col("item_place"))
    slots = placed.select(
        *occurrence, "item_place", "template", F.explode_outer(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))).alias("s")
    )
    mapped = slots.groupBy(*occurrence, F.col("s.a").alias("value")).agg(
        F.collect_set("item_place").alias("item_places"),
        F.collect_set(F.when(F.col("template"), F.col("item_place"))).alias("template_places"),
        (F.min("s.b") < F.max("s.b")).alias("conflict"),
        F.min("s.b").alias("becomes"),
    )
    is_slot = F.col("value") != 0
    checked = mapped.groupBy(*occurrence).agg(
        F.array_distinct(F.flatten(F.collect_list("item_places"))).alias("item_places"),
        F.array_distinct(F.flatten(F.collect_list("template_places"))).alias("template_places"),
        F.count_if(is_slot).alias("n_slots"),
        F.count_if(is_slot & F.col("conflict")).alias("n_split"),
        F.countDistinct(F.when(is_slot, F.col("becomes"))).alias("n_becomes"),
    ).withColumn("n_conflicts", F.col("n_split") + F.col("n_slots") - F.col("n_becomes")).drop("n_split", "n_becomes")
    agreeing = checked.where(F.col("n_conflicts") <= MOST_CONFLICTS * F.col("n_slots"))
    whole = agreeing.groupBy(*pair).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("item_places")))).cast("long").alias("n_matched"),
        F.size(F.array_distinct(F.flatten(F.collect_list("template_places")))).alias("n_as_template"),
        F.sum("n_slots").alias("n_slots"),
        F.sum("n_conflicts").alias("n_conflicts"),
    )
    as_template = (F.col("n_as_template") > 0) & (F.col("n_as_template") >= LEAST_SHARE * F.col("item_templates"))
    held = whole.where(as_template | (F.col("n_matched") >= LEAST_SHARE * F.col("item_windows")))
    return held.drop("item_templates", "n_as_template").withColumnRenamed("item_windows", "n_windows")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no item.

    Missing and empty texts hold none and stay; repeated rows stay or go together; an empty
    benchmark keeps all documents; columns of any names pass through.
    """
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leak_id"), F.col("row_key").alias("_leak_key")).distinct()
    same = (row_key(docs) == leaks["_leak_key"]) & docs["doc_id"].eqNullSafe(leaks["_leak_id"])
    return docs.join(leaks, same, "left_anti")


def leak_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``find_leaks`` by ``doc_id``; different texts with one id give a row each, and a missing id stays missing."""
    return find_leaks(docs, benchmark).drop("row_key")
