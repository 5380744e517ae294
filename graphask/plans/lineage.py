"""Cutting lineage on storage that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(SETTING, None)
    if shared is None:
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    context.setCheckpointDir(shared)


def use_local_scratch(spark: SparkSession) -> None:
    """Give a single-machine session without ``spark.checkpoint.dir`` a temporary folder.

    For tests, benchmarks and the entry module; on a cluster this does nothing, and
    whatever needs the folder raises.
    """
    context = spark.sparkContext
    one_machine = context.master == "local" or context.master.startswith("local[")
    if one_machine and context.getCheckpointDir() is None and spark.conf.get(SETTING, None) is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphask-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder named by the session."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
