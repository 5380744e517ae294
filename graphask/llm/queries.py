"""One query per operator of this package, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from graphask.llm import sharding
from graphask.llm.columns import table
from graphask.llm.conversation_repair import repair_digest
from graphask.llm.decontaminate import leak_digest
from graphask.llm.license_scan import scan_licenses
from graphask.llm.masked_lm import score_documents
from graphask.llm.oracles import ORACLES as ORACLES
from graphask.llm.ordinal_quality import quality_grades
from graphask.llm.quality_rules import quality_digest
from graphask.llm.secret_scan import secret_digest
from graphask.llm.simhash import simhash_digest
from graphask.llm.soft_mixing import MIX_TARGETS, labelled_languages, mixing_rates
from graphask.llm.spelling_variants import spelling_variants
from graphask.llm.suffix_dedup import repeat_digest
from graphask.llm.toxicity_fm import toxicity_digest

def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing_rates(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), MIX_TARGETS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_masked_lm": op7_masked_lm,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}
