"""Text operators as column expressions; everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms U+FF01..U+FF5E mirror ASCII 0x21..0x7E; U+3000 is the wide blank.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "

SEPARATORS = r"[^\p{L}\p{N}#_]+"
HAN = r"(\p{IsHan})"
# Every Han character and every full-width form lies here.
EAST_ASIAN = r"[\x{2E80}-\x{10FFFF}]"
_FOLD_BLOCK = 64


def _needs_folding(text: Column, variants: tuple[str, str]) -> Column:
    """Whether a text can hold wide forms, Han characters or variants; ASCII is settled by its length."""
    source, _ = variants
    if any(ord(c) < 0x80 for c in source):
        return F.lit(True)
    beyond_ascii = F.octet_length(text) != F.char_length(text)
    if any(ord(c) < 0x2E80 for c in source):
        return beyond_ascii
    return beyond_ascii & text.rlike(EAST_ASIAN)


def _fold_width(text: Column, variants: tuple[str, str]) -> Column:
    source, target = variants
    return F.translate(text, FULL_WIDTH + source, HALF_WIDTH + target)


def normalize(text: Column, variants: tuple[str, str] = ("", "")) -> Column:
    """Fold width and case; ``variants`` adds a character map such as traditional -> simplified."""
    return F.lower(F.when(_needs_folding(text, variants), _fold_width(text, variants)).otherwise(text))


def tokenize(text: Column, variants: tuple[str, str] = ("", "")) -> Column:
    """Words of a text; in unspaced Han script every character is a token of its own.

    Multi-character Han words come out of the dictionary and vocabulary match
    that follows, so both kinds of script share one path.
    """
    spaced = F.regexp_replace(_fold_width(text, variants), HAN, " $1 ")
    plain = F.when(_needs_folding(text, variants), spaced).otherwise(text)
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def phrase_key(text: Column, variants: tuple[str, str] = ("", "")) -> Column:
    """The join key of a dictionary entry: its tokens, blank-joined."""
    return F.array_join(tokenize(text, variants), " ")


def ngrams(tokens: Column, lengths: Sequence[int]) -> Column:
    """Every run of ``lengths`` consecutive tokens: all runs of one length, then of the next."""
    nothing = F.slice(F.array(F.lit("")), 1, 0)

    def of_length(k: int) -> Column:
        if k == 1:
            return tokens
        starts = F.sequence(F.lit(1), F.size(tokens) - (k - 1))
        runs = F.transform(starts, lambda start: F.array_join(F.slice(tokens, start, F.lit(k)), " "))
        return F.when(F.size(tokens) >= k, runs).otherwise(nothing)

    return F.concat(*[of_length(k) for k in lengths])


def ngram_place(position: Column, n_tokens: Column, lengths: Sequence[int]) -> Column:
    """``struct(start, len)`` of the run at ``position`` of :func:`ngrams`."""
    place = F.lit(None)
    offset = F.lit(0)
    bounds = []
    for k in lengths:
        runs = F.greatest(n_tokens - (k - 1), F.lit(0))
        bounds.append((offset, offset + runs, k))
        offset = offset + runs
    for first, last, k in reversed(bounds):
        here = F.struct((position - first).alias("start"), F.lit(k).alias("len"))
        place = F.when(position < last, here).otherwise(place)
    return place


def leftmost_longest(hits: Column) -> Column:
    """Non-overlapping hits, leftmost first and longest at each start.

    ``hits`` is ``array<struct<start, neg_len, len, word, tag>>``, sorted. Kept
    hits are gathered in blocks so that the fold stays linear on long texts.
    """
    none = F.slice(hits, 1, 0)
    no_blocks = F.slice(F.array(hits), 1, 0)

    def step(state: Column, hit: Column) -> Column:
        block = state["block"]
        full = F.size(block) >= _FOLD_BLOCK
        taken = F.struct(
            (hit["start"] + hit["len"]).alias("end"),
            F.when(full, F.array(hit)).otherwise(F.concat(block, F.array(hit))).alias("block"),
            F.when(full, F.concat(state["blocks"], F.array(block))).otherwise(state["blocks"]).alias("blocks"),
        )
        return F.when(hit["start"] >= state["end"], taken).otherwise(state)

    kept = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("end"), none.alias("block"), no_blocks.alias("blocks")),
        step,
        lambda state: F.concat(F.flatten(state["blocks"]), state["block"]),
    )
    return F.when(F.size(hits) == 1, hits).otherwise(kept)


def cheapest_path(hits: Column, other_cost: float) -> Column:
    """Non-overlapping hits whose costs, with ``other_cost`` for every token outside of them, are least in sum.

    ``hits`` is ``array<struct<start, neg_len, len, word, tag, cost>>``, sorted. The fold
    keeps the cheapest way to each end still ahead and one way to where the next hit
    starts. Where no hit overlaps the next one the way so far is settled, so the work is
    linear in the text and quadratic only in a chain of overlapping hits.
    """
    none = F.slice(hits, 1, 0)
    no_blocks = F.slice(F.array(hits), 1, 0)

    def way(end: Column, cost: Column, path: Column) -> Column:
        return F.struct(end.cast("int").alias("end"), cost.cast("double").alias("cost"), path.alias("path"))

    def cheapest(ways: Column, at: Column) -> Column:
        there = F.transform(ways, lambda w: F.struct((w["cost"] + other_cost * (at - w["end"])).alias("cost"), w["path"].alias("path")))
        return F.array_min(there)

    def settle(state: Column, path: Column) -> tuple[Column, Column]:
        block = F.concat(state["block"], path)
        full = F.size(block) >= _FOLD_BLOCK
        blocks = F.when(full, F.concat(state["blocks"], F.array(block))).otherwise(state["blocks"])
        return blocks, F.when(full, none).otherwise(block)

    def step(state: Column, hit: Column) -> Column:
        start, end = hit["start"], hit["start"] + hit["len"]
        ahead = F.filter(state["ways"], lambda w: w["end"] > start)
        # A list of one, so that what is computed once is used several times.
        base = F.array(cheapest(F.filter(state["ways"], lambda w: w["end"] <= start), start))
        closed = F.size(ahead) == 0
        blocks, block = settle(state, F.get(base, F.lit(0))["path"])
        here = F.transform(base, lambda b: way(start, F.when(closed, 0.0).otherwise(b["cost"]), F.when(closed, none).otherwise(b["path"])))
        longer = F.transform(here, lambda w: way(end, w["cost"] + hit["cost"], F.concat(w["path"], F.array(hit))))
        new_cost = F.get(longer, F.lit(0))["cost"]
        kept = F.filter(ahead, lambda w: (w["end"] != end) | (w["cost"] <= new_cost))
        added = F.when(F.exists(kept, lambda w: w["end"] == end), F.slice(longer, 1, 0)).otherwise(longer)
        return F.struct(
            F.when(closed, blocks).otherwise(state["blocks"]).alias("blocks"),
            F.when(closed, block).otherwise(state["block"]).alias("block"),
            F.concat(here, kept, added).alias("ways"),
        )

    def finish(state: Column) -> Column:
        furthest = F.array_max(F.transform(state["ways"], lambda w: w["end"]))
        return F.concat(F.flatten(state["blocks"]), state["block"], cheapest(state["ways"], furthest)["path"])

    first = F.array(way(F.lit(0), F.lit(0.0), none))
    start = F.struct(no_blocks.alias("blocks"), none.alias("block"), first.alias("ways"))
    return F.aggregate(hits, start, step, finish)


def _end_of(span: Column) -> Column:
    return F.coalesce(span["start"] + span["len"], F.lit(0))


def _weave(tokens: Column, spans: Column, plain, entity) -> Column:
    """Plain stretches and spans in text order; linear, the stretches are sliced out."""

    def stretch(first: Column, count: Column) -> Column:
        return plain(F.slice(tokens, first + 1, count), first)

    def piece(span: Column, i: Column) -> Column:
        previous_end = _end_of(F.get(spans, i - 1))
        return F.concat(stretch(previous_end, span["start"] - previous_end), F.array(entity(span)))

    last_end = _end_of(F.element_at(spans, -1))
    woven = F.concat(
        F.flatten(F.transform(spans, piece)), stretch(last_end, F.size(tokens) - last_end)
    )
    return F.when(F.size(spans) > 0, woven).otherwise(plain(tokens, F.lit(0)))


def merge_terms(tokens: Column, spans: Column) -> Column:
    """Tokens with every span replaced by one term: ``array<struct<pos, word, tag>>``."""

    def plain(words: Column, first: Column) -> Column:
        return F.transform(
            words,
            lambda word, i: F.struct(
                (first + i).alias("pos"), word.alias("word"), F.lit(None).cast("string").alias("tag")
            ),
        )

    def entity(span: Column) -> Column:
        return F.struct(span["start"].alias("pos"), span["word"].alias("word"), span["tag"].alias("tag"))

    return _weave(tokens, spans, plain, entity)


def merge_words(tokens: Column, spans: Column) -> Column:
    """The words of the abstracted text straight from tokens and spans."""
    return _weave(
        tokens, spans, lambda words, first: words, lambda span: F.coalesce(span["tag"], span["word"])
    )


def abstract_words(terms: Column) -> Column:
    """The words of the abstracted text: tags for entities, words for the rest."""
    return F.transform(terms, lambda term: F.coalesce(term["tag"], term["word"]))


def abstract_text(terms: Column) -> Column:
    return F.array_join(abstract_words(terms), " ")


def mention_map(terms: Column) -> Column:
    """Tag -> word; the last mention of a tag wins. Takes terms or spans."""
    tagged = F.filter(terms, lambda term: term["tag"].isNotNull())
    tags = F.array_distinct(F.transform(tagged, lambda term: term["tag"]))
    last_words = F.transform(
        tags,
        lambda tag: F.element_at(F.filter(tagged, lambda term: term["tag"] == tag), -1)["word"],
    )
    return F.map_from_arrays(tags, last_words)


def fill_template(pattern: Column, mentions: Column) -> Column:
    """The tokens of a pattern with each tag replaced by its word; other tokens stay.

    Whole tokens are replaced, so a tag that is a prefix of another tag is safe,
    and the result stays an array, so a name of several words is one slot.
    """
    return F.transform(F.split(pattern, " "), lambda token: F.coalesce(F.try_element_at(mentions, token), token))


def slot(filled: Column, number: int) -> Column:
    """Slot 1 or 2 of a filled template."""
    return F.get(filled, F.lit(number - 1))
