"""From raw documents to balanced shards: quality, near duplicates, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphask.llm.columns import table
from graphask.llm.decontaminate import without_leaks
from graphask.llm.ordinal_quality import keep_good
from graphask.llm.sharding import shards
from graphask.llm.simhash import one_of_each
from graphask.llm.soft_mixing import MIX_TARGETS, labelled_languages, mixed_without_loss
from graphask.plans.lineage import stored, use_local_scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the graded quality model does not reject."""
    use_local_scratch(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    use_local_scratch(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    use_local_scratch(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until the languages have their shares of the tokens; none is lost."""
    use_local_scratch(spark)
    return mixed_without_loss(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), MIX_TARGETS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mixture."""
    use_local_scratch(spark)
    return shards(docs)


STAGES = [
    ("ordinal_quality", good_quality),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("soft_mixing", mixing),
    ("sharding", sharding),
]

#: Models trained with numpy and iterated contractions have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written before the next stage reads it."""
    use_local_scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
