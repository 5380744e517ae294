"""A dictionary that changes while questions are answered: numbered snapshots, written one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphask import schemas
from graphask.operators.dictionary import upsert_words

_ENTRY = ("word", "tag", "freq", "load_order")


class DictionaryVersions:
    """Snapshots ``word, tag, freq, load_order`` under a shared folder.

    Snapshot 0 is the dictionary at the start, snapshot ``n`` holds the first ``n``
    batches of updates. A snapshot counts once its number is in the log, which is
    written after it, so a reader never sees half of one. Old snapshots stay, so that a
    batch of questions that is run again finds the one it used.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, dictionary: DataFrame, path: str) -> DictionaryVersions:
        versions = cls(dictionary.sparkSession, path)
        versions._write(dictionary, 0)
        return versions

    def _write(self, dictionary: DataFrame, version: int) -> None:
        dictionary.select(*_ENTRY).write.mode("overwrite").parquet(f"{self.path}/entries/version={version}")
        _note(self.spark, f"{self.path}/log", version, version)

    def latest(self) -> int:
        return _noted(self.spark, f"{self.path}/log").agg(F.max("value")).first()[0]

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(schemas.DICTIONARY).parquet(f"{self.path}/entries/version={version}").select(*_ENTRY)

    def fold(self, updates: DataFrame, batch_id: int) -> None:
        """Snapshot ``batch_id + 1`` from the one before and a batch ``word, attr, load_order``; again gives the same."""
        self._write(upsert_words(self.read(batch_id), updates), batch_id + 1)

    def pinned(self, pins: str, batch_id: int) -> int:
        """The snapshot that a batch of questions uses: the latest one, or when it is run again the one it used before."""
        if batch_id == 0:
            _note(self.spark, pins, -1, 0, "ignore")
        used = _noted(self.spark, pins).where(F.col("number") == batch_id).first()
        if used is not None:
            return used["value"]
        version = self.latest()
        _note(self.spark, pins, batch_id, version)
        return version


def _note(spark: SparkSession, path: str, number: int, value: int, mode: str = "overwrite") -> None:
    row = spark.range(value, value + 1, 1, 1).withColumnRenamed("id", "value")
    row.write.mode(mode).parquet(f"{path}/number={number}")


def _noted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value long, number long").parquet(path)


def update_dictionary(
    updates: DataFrame, versions: DictionaryVersions, checkpoint: str, available_now: bool = False, interval: str = "10 seconds"
) -> StreamingQuery:
    """Fold a stream ``word, attr, load_order`` into new snapshots, one for each micro-batch."""
    writer = updates.writeStream.foreachBatch(versions.fold).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
