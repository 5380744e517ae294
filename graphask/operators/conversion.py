"""Phrase conversion: a table of phrases and what to write instead, such as traditional and simplified spellings.

Unlike a map of single characters, an entry may be of any length and change the
length of the text. The match is the one of the dictionary, on characters instead of
words: of all entries in a text the leftmost counts, and of those the longest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphask.functions import text as tx
from graphask.operators.tagging import candidate_phrases, match_candidates
from graphask.plans import broadcast_if_bounded, cut_lineage
from graphask.plans.broadcast import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS


def characters(text: Column) -> Column:
    """The code points of a text."""
    return F.array_remove(F.split(text, ""), "")


class ConversionTable:
    """``source, target, load_order`` made ready for matching; a table over the limits is met by a shuffle.

    Of several targets of a source the one loaded first counts, ties go to the smallest.
    Entries without a source or a target are left out; an empty target deletes.
    """

    facts = ("word", "tag")

    def __init__(
        self, entries: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
    ) -> None:
        real = entries.where((F.col("source") != "") & F.col("target").isNotNull())
        first = F.min(F.struct("load_order", "target"))["target"]
        # Characters are blank-joined like the tokens of a phrase; each second place is the blank, so keys stay unique.
        table = cut_lineage(
            real.groupBy("source").agg(first.alias("word")).select(
                F.array_join(characters(F.col("source")), " ").alias("phrase"),
                "word",
                F.lit(None).cast("string").alias("tag"),
            )
        )
        length = F.ceil(F.char_length("phrase") / 2).cast("int")
        firsts = cut_lineage(
            table.groupBy(F.substring("phrase", 1, 1).alias("first")).agg(F.sort_array(F.collect_set(length)).alias("lengths"))
        )
        lengths = table.agg(F.sort_array(F.collect_set(length)).alias("lengths")).first()["lengths"]
        self.lengths: list[int] = lengths or [1]
        self.firsts, self.firsts_broadcast = broadcast_if_bounded(firsts, max_rows, max_bytes)
        self.table, self.is_broadcast = broadcast_if_bounded(table, max_rows, max_bytes)


def convert_phrases(texts: DataFrame, conversion: ConversionTable, key: str = "question_id", text: str = "text") -> DataFrame:
    """``texts`` with the phrases of the table replaced in ``text``, from left to right, the longest first.

    ``key`` is unique per text. What was written is not matched again. Characters that
    begin no entry are dropped before anything is joined, and only hits travel back to
    the texts, so texts without a phrase come out as they are. A missing text stays missing.
    """
    chars = texts.select(key, characters(F.col(text)).alias("tokens"))
    hits = match_candidates(candidate_phrases(chars, conversion, key), conversion, key)
    hit = F.struct("start", (-F.col("len")).alias("neg_len"), "len", *conversion.facts)
    spans = hits.groupBy(key).agg(tx.leftmost_longest(F.sort_array(F.collect_list(hit))).alias("_spans"))
    converted = F.array_join(tx.merge_words(characters(F.col(text)), F.col("_spans")), "")
    joined = texts.join(spans, key, "left")
    new = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(converted)
    return joined.withColumn(text, new).drop("_spans").select(*texts.columns)
