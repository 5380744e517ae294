"""Question tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphask import schemas


def read_questions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.QUESTIONS).load(path)


def stream_questions(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Questions that arrive as files in a folder."""
    reader = spark.readStream.format(fmt).schema(schemas.QUESTIONS)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
