"""Entity dictionary maintenance: add, upsert, conflict report and resolution.

Every operator aggregates per word with partial aggregation, so a word that
fills a third of the table is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTEGER = r"^[+-]?[0-9]+$"


def parse_attribute(attr: Column) -> Column:
    """``"tag freq"`` -> ``struct(tag, freq, valid)``.

    Exactly two parts are valid. A bare tag has frequency 1; any other shape has
    neither tag nor frequency.
    """
    parts = F.split(attr, " ")
    valid = (F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike(_INTEGER)
    bare = F.size(parts) == 1
    return F.struct(
        F.when(valid | bare, F.get(parts, F.lit(0))).alias("tag"),
        F.when(valid, F.get(parts, F.lit(1)).try_cast("int")).when(bare, F.lit(1)).alias("freq"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def resolve_conflicts(dictionary: DataFrame) -> DataFrame:
    """One row per word: the entry that was loaded first; tag order settles equal load orders."""
    first = F.min(F.struct("load_order", "tag", "freq")).alias("first")
    return dictionary.groupBy("word").agg(first).select(
        "word", "first.tag", "first.freq", "first.load_order"
    )


def dictionary_conflicts(dictionary: DataFrame) -> DataFrame:
    """Words listed under several tags, with the tag that is kept."""
    return (
        dictionary.groupBy("word")
        .agg(
            F.array_sort(F.collect_set("tag")).alias("tags"),
            F.min(F.struct("load_order", "tag")).alias("first"),
        )
        .where(F.size("tags") > 1)
        .select("word", F.size("tags").alias("n_tags"), "tags", F.col("first.tag").alias("kept_tag"))
    )


def add_words(dictionary: DataFrame, additions: DataFrame) -> DataFrame:
    """Add entries whose word is absent; present words stay as they are."""
    absent = resolve_conflicts(additions).join(dictionary.select("word").distinct(), "word", "left_anti")
    return dictionary.unionByName(absent.select(*dictionary.columns))


def upsert_words(dictionary: DataFrame, updates: DataFrame) -> DataFrame:
    """Forced update from ``word, attr, load_order``.

    A present word takes the tag of its last well-formed update and the
    frequency of its last update (0 when that one is malformed). An absent word
    is added with its first update.
    """
    parsed = updates.withColumn("parsed", parse_attribute(F.col("attr")))
    per_word = parsed.groupBy("word").agg(
        F.max(F.when(F.col("parsed.valid"), F.struct("load_order", "parsed.tag"))).alias("last_valid"),
        F.max(F.struct("load_order", F.when(F.col("parsed.valid"), F.col("parsed.freq")).alias("freq"))).alias("last"),
        F.min(F.struct("load_order", "parsed.tag", "parsed.freq")).alias("first"),
    )
    current = resolve_conflicts(dictionary)
    joined = current.alias("d").join(per_word.alias("u"), "word", "full_outer")
    known = F.col("d.load_order").isNotNull()
    updated = F.col("u.last").isNotNull()
    return joined.select(
        "word",
        F.when(known, F.coalesce("last_valid.tag", "d.tag")).otherwise(F.col("first.tag")).alias("tag"),
        F.when(known & updated, F.coalesce("last.freq", F.lit(0)))
        .when(known, F.col("d.freq"))
        .otherwise(F.col("first.freq"))
        .alias("freq"),
        F.coalesce("d.load_order", "first.load_order").alias("load_order"),
    )
