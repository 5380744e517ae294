"""Questions that arrive over time, answered batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphask.plans.answer_questions import QuestionEngine
from graphask.sources import write_answers
from graphask.streaming.dictionary_versions import DictionaryVersions


def answer_stream(
    questions: DataFrame,
    engine: QuestionEngine,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "10 seconds",
    versions: DictionaryVersions | None = None,
) -> StreamingQuery:
    """Write the answers of each micro-batch to its own partition of ``path``.

    A replayed batch overwrites its partition, so every question is answered
    exactly once. The engine is trained before the stream starts and shared by
    all batches. With ``versions`` each batch is tagged by the newest dictionary, whose
    number is written down first, so a replayed batch is tagged as it was; the lexicon
    is built again only when the number changes.
    """
    current: dict[int, QuestionEngine] = {}

    def engine_for(batch_id: int) -> QuestionEngine:
        if versions is None:
            return engine
        version = versions.pinned(f"{checkpoint}/dictionary-versions", batch_id)
        if version not in current:
            current.clear()
            current[version] = engine.with_dictionary(versions.read(version))
        return current[version]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write_answers(engine_for(batch_id).answer(batch), f"{path}/batch_id={batch_id}", mode="overwrite")

    writer = questions.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
