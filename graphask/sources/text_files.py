"""Text-file sources: entity dictionaries, vocabulary, templates, training samples.

Every reader is ``spark.read.text`` plus a parser that works on a ``value``
column, so the same parsers run on lines that come from anywhere else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# The entity tags in the order their dictionaries are loaded.
DICTIONARY_ORDER = ("nap", "nba", "ndi", "neq", "nha", "nve", "napl")

_HEADER = "====="


def parse_dictionary(lines: DataFrame, tag: str, load_order: int = 0) -> DataFrame:
    """One word per line -> ``word, tag, freq, load_order``; the frequency is always 0."""
    word = F.trim("value")
    return lines.where(word != "").select(
        word.alias("word"),
        F.lit(tag).alias("tag"),
        F.lit(0).alias("freq"),
        F.lit(load_order).cast("long").alias("load_order"),
    )


def read_dictionary(spark: SparkSession, path: str, tag: str, load_order: int = 0) -> DataFrame:
    return parse_dictionary(spark.read.text(path), tag, load_order)


def union_dictionaries(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def read_dictionaries(
    spark: SparkSession,
    paths: Mapping[str, str],
    order: Sequence[str] = DICTIONARY_ORDER,
) -> DataFrame:
    """All dictionaries of ``paths`` (tag -> path) in load order."""
    return union_dictionaries([
        read_dictionary(spark, paths[tag], tag, position)
        for position, tag in enumerate(order)
        if tag in paths
    ])


def _indexed(lines: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``idx:text`` lines, cut at the first colon; a byte-order mark is stripped from the index."""
    parts = F.split("value", ":", 2)
    index = F.replace(F.get(parts, F.lit(0)), F.lit("﻿"), F.lit(""))
    return lines.where(F.trim("value") != ""), index, F.get(parts, F.lit(1))


def parse_vocabulary(lines: DataFrame) -> DataFrame:
    rows, index, word = _indexed(lines)
    return rows.select(index.cast("int").alias("idx"), word.alias("word"))


def parse_templates(lines: DataFrame) -> DataFrame:
    rows, index, pattern = _indexed(lines)
    return rows.select(index.cast("double").cast("int").alias("template_id"), pattern.alias("pattern"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return parse_vocabulary(spark.read.text(path))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return parse_templates(spark.read.text(path))


def label_sections(lines: DataFrame) -> DataFrame:
    """Give every line the label of the section header above it.

    ``lines`` has ``file, split, seq, value``: ``split`` orders the pieces of a
    file, ``seq`` the lines of a piece. A header opens a section
    (``===== id pattern =====``) and blank lines are skipped. Lines above the
    first header of a file belong to that header; all sections of an id count,
    in one file or many. No group is larger than one piece: the label
    open at the end of each piece is carried over between pieces in a table
    with one row per piece.
    """
    is_header = F.startswith("value", F.lit(_HEADER))
    header = F.when(is_header, F.get(F.split("value", " "), F.lit(1)).cast("int"))
    marked = lines.where(F.col("value") != "").withColumn("header", header)

    so_far = Window.partitionBy("file", "split").orderBy("seq")
    within = marked.withColumn("open", F.last("header", ignorenulls=True).over(so_far))

    per_split = marked.where(F.col("header").isNotNull()).groupBy("file", "split").agg(
        F.max_by("header", "seq").alias("last_header"),
        F.min_by("header", "seq").alias("first_header"),
    )
    splits = marked.select("file", "split").distinct().join(per_split, ["file", "split"], "left")
    by_file = Window.partitionBy("file").orderBy("split")
    carried = splits.select(
        "file",
        "split",
        F.last("last_header", ignorenulls=True)
        .over(by_file.rowsBetween(Window.unboundedPreceding, -1))
        .alias("carried"),
        F.first("first_header", ignorenulls=True)
        .over(by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("opening"),
    )
    labelled = (
        within.where(F.col("header").isNull())
        .join(carried, ["file", "split"])
        .withColumn("section", F.coalesce("open", "carried", "opening"))
    )
    return labelled.select("section", F.col("value").alias("sentence")).withColumnRenamed("section", "label")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sectioned training corpus -> ``label, sentence``; raises when it is empty."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    samples = label_sections(lines)
    if samples.isEmpty():
        raise ValueError(f"no training samples in {path}")
    return samples
