"""Dictionary matching: find the entries of a dictionary in texts of any length.

Every token is exploded next to the text key, with the few tokens that the longest
entry could need. Tokens that start no entry are dropped first; only the others grow
into n-grams, of the lengths that entries with this first token have, and these are
joined to the dictionary. Tables within the broadcast limit are map-side hash joins;
larger ones are shuffle joins with hot keys salted. Only hits travel back to the text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphask.functions import text as tx
from graphask.plans import broadcast_if_bounded, cut_lineage, find_hot_keys, salted_join
from graphask.plans.broadcast import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, Size, size_columns

NO_VARIANTS = ("", "")


def build_lexicon(
    dictionary: DataFrame,
    vocabulary: DataFrame | None = None,
    variants: tuple[str, str] = NO_VARIANTS,
) -> DataFrame:
    """Match table ``phrase, n_tokens, word, tag`` with one row per phrase.

    Vocabulary entries of several tokens are matched too, without a tag, so they
    come out as one word; a dictionary entry wins over a vocabulary entry.
    """
    entries = dictionary.select("word", "tag", "freq", "load_order")
    if vocabulary is not None:
        words = vocabulary.select(
            tx.normalize(F.col("word"), variants).alias("word"),
            F.lit(None).cast("string").alias("tag"),
            F.lit(0).alias("freq"),
            F.lit((1 << 63) - 1).cast("long").alias("load_order"),
        ).where(F.size(tx.tokenize(F.col("word"), variants)) > 1)
        entries = entries.unionByName(words)
    keyed = entries.withColumn("phrase", tx.phrase_key(F.col("word"), variants)).where(F.col("phrase") != "")
    first = F.min(F.struct("load_order", "tag", "word")).alias("first")
    freq = F.max(F.coalesce("freq", F.lit(0))).cast("long").alias("freq")
    return keyed.groupBy("phrase").agg(first, freq).select(
        "phrase",
        F.size(F.split("phrase", " ")).alias("n_tokens"),
        "first.word",
        "first.tag",
        "freq",
    )


class Lexicon:
    """A match table, materialised once, with its measured facts: phrase lengths and size.

    Overlapping hits are settled leftmost and longest, or ``by_frequency``: each entry
    costs the negative logarithm of its share of all frequencies (one added to each),
    each other token as much as an entry of frequency 0, and the cheapest way through a
    text counts.
    """

    def __init__(
        self,
        dictionary: DataFrame,
        vocabulary: DataFrame | None = None,
        variants: tuple[str, str] = NO_VARIANTS,
        max_rows: int = MAX_BROADCAST_ROWS,
        max_bytes: int = MAX_BROADCAST_BYTES,
        by_frequency: bool = False,
    ) -> None:
        self.variants = variants
        self.by_frequency = by_frequency
        self.vocabulary = vocabulary
        self._limits = max_rows, max_bytes
        table = cut_lineage(build_lexicon(dictionary, vocabulary, variants))
        facts = table.agg(
            *size_columns(table),
            F.sort_array(F.collect_set("n_tokens")).alias("lengths"),
            F.sum(F.col("freq") + 1).alias("mass"),
        ).first()
        self.other_cost = math.log(facts["mass"] or 1)
        cost = F.lit(self.other_cost) - F.log(F.col("freq") + 1.0)
        self.lengths: list[int] = facts["lengths"] or [1]
        first = F.substring_index("phrase", " ", 1).alias("first")
        firsts = cut_lineage(
            table.groupBy(first).agg(F.sort_array(F.collect_set("n_tokens")).alias("lengths"))
        )
        # Not larger than the table but for the lists, which hold at most the lengths there are.
        size = firsts.agg(F.count(F.lit(1)), F.sum(F.octet_length("first") + 8 * F.size("lengths"))).first()
        self.firsts, self.firsts_broadcast = broadcast_if_bounded(firsts, max_rows, max_bytes, Size(size[0], size[1] or 0))
        self.table, self.is_broadcast = broadcast_if_bounded(
            table.select("phrase", "word", "tag", *([cost.alias("cost")] if by_frequency else [])),
            max_rows,
            max_bytes,
            Size(facts["rows"], facts["bytes"]),
        )

    def with_dictionary(self, dictionary: DataFrame) -> Lexicon:
        """The match table of another dictionary, with the same vocabulary and settings."""
        return Lexicon(dictionary, self.vocabulary, self.variants, *self._limits, self.by_frequency)

    @property
    def facts(self) -> list[str]:
        """What a hit carries of its entry."""
        return ["word", "tag", "cost"] if self.by_frequency else ["word", "tag"]


def _salted(rows: DataFrame, table: DataFrame, on: str, key: str) -> DataFrame:
    counts = rows.groupBy(on).agg(F.count("*").alias("n"))
    return salted_join(rows, table, [on], find_hot_keys(counts, [on]), key)


def match_candidates(candidates: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    if lexicon.is_broadcast:
        return candidates.join(lexicon.table, "phrase")
    return _salted(candidates, lexicon.table, "phrase", key)


def candidate_phrases(tokens: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """``key, start, len, phrase``: the n-grams of ``tokens`` that begin like an entry and are as long as one."""
    reach = max(lexicon.lengths)
    each = F.transform(
        "tokens",
        lambda token, i: F.struct(token.alias("first"), F.slice("tokens", i + 1, F.lit(reach)).alias("ahead")),
    )
    starts = tokens.select(key, F.posexplode(each).alias("start", "at")).select(key, "start", "at.first", "at.ahead")
    if lexicon.firsts_broadcast:
        known = starts.join(lexicon.firsts, "first")
    else:
        known = _salted(starts, lexicon.firsts, "first", key)
    grown = known.select(key, "start", "ahead", F.explode("lengths").alias("len")).where(F.size("ahead") >= F.col("len"))
    phrase = F.array_join(F.slice("ahead", F.lit(1), F.col("len")), " ")
    return grown.select(key, "start", "len", phrase.alias("phrase"))


def find_mentions(texts: DataFrame, lexicon: Lexicon, key: str = "question_id", text: str = "text") -> DataFrame:
    """All dictionary hits, overlaps included: ``key, start, len, word, tag``, and ``cost`` where frequencies count."""
    tokens = texts.select(key, tx.tokenize(F.col(text), lexicon.variants).alias("tokens"))
    hits = match_candidates(candidate_phrases(tokens, lexicon, key), lexicon, key)
    return hits.select(key, "start", "len", *lexicon.facts)


def match_spans(texts: DataFrame, lexicon: Lexicon, key: str = "question_id", text: str = "text") -> DataFrame:
    """Add ``tokens`` and ``spans``, the dictionary hits without overlaps.

    ``key`` is unique per text. The hits are grouped by ``key`` and joined back
    to the texts: one shuffle of the texts and one of the hits, and none at all
    for a table that is bucketed by ``key``.
    """
    hits = find_mentions(texts, lexicon, key, text)
    hit = F.struct("start", (-F.col("len")).alias("neg_len"), "len", *lexicon.facts)
    settled = tx.cheapest_path(F.col("hits"), lexicon.other_cost) if lexicon.by_frequency else tx.leftmost_longest(F.col("hits"))
    spans = (
        hits.groupBy(key)
        .agg(F.sort_array(F.collect_list(hit)).alias("hits"))
        .select(key, settled.alias("spans"))
    )
    no_spans = F.from_json(F.lit("[]"), spans.schema["spans"].dataType.simpleString())
    return texts.join(spans, key, "left").withColumns({
        "tokens": tx.tokenize(F.coalesce(F.col(text), F.lit("")), lexicon.variants),
        "spans": F.coalesce("spans", no_spans),
    })


def tag_entities(texts: DataFrame, lexicon: Lexicon, key: str = "question_id", text: str = "text") -> DataFrame:
    """Add ``terms``: the words of each text in order, dictionary entries tagged."""
    matched = match_spans(texts, lexicon, key, text)
    return matched.withColumn("terms", tx.merge_terms(F.col("tokens"), F.col("spans"))).drop("tokens", "spans")


def explode_terms(tagged: DataFrame, key: str = "question_id") -> DataFrame:
    """Term table ``key, pos, word, tag``."""
    return tagged.select(key, F.explode("terms").alias("term")).select(
        key, "term.pos", "term.word", "term.tag"
    )


def last_mentions(terms: DataFrame, key: str = "question_id") -> DataFrame:
    """Table form of the mention map: one row per text and tag, the last mention wins."""
    return (
        terms.where(F.col("tag").isNotNull())
        .groupBy(key, "tag")
        .agg(F.max_by("word", "pos").alias("word"))
    )


def highest_tag(terms: Column, order: Sequence[str]) -> Column:
    """The tag of a text that comes first in ``order``; null without one.

    Tags are compared whole, so a tag that is a prefix of another one is safe.
    """
    tags = F.transform(terms, lambda term: term["tag"])
    return F.get(F.filter(F.array(*[F.lit(tag) for tag in order]), lambda tag: F.array_contains(tags, tag)), F.lit(0))
