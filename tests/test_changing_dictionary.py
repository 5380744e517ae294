"""Questions answered while the dictionary changes."""

import pytest

from aquaculture import tables
from graphask import aquaculture_catalog, build_engine, schemas
from graphask.sources import stream_questions
from graphask.streaming import DictionaryVersions, answer_stream, update_dictionary

UPDATE = "word string, attr string, load_order long"


@pytest.fixture(scope="module")
def engine(spark):
    return build_engine(spark, catalog=aquaculture_catalog(), **tables(spark))


def test_a_question_before_and_after_an_update(spark, engine, tmp_path):
    versions = DictionaryVersions.create(tables(spark)["dictionary"], str(tmp_path / "versions"))

    def ask(question_id):
        row = [(question_id, "白鲢住在哪里")]
        spark.createDataFrame(row, schemas.QUESTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "questions"))
        arriving = stream_questions(spark, str(tmp_path / "questions"))
        answer_stream(arriving, engine, str(tmp_path / "out"), str(tmp_path / "asked"), True, versions=versions).awaitTermination()
        return {r["question_id"]: (r["slot1"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    def update(*rows):
        spark.createDataFrame(rows, UPDATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "updates"))
        arriving = spark.readStream.schema(UPDATE).parquet(str(tmp_path / "updates"))
        update_dictionary(arriving, versions, str(tmp_path / "folded"), available_now=True).awaitTermination()

    assert ask(1)[1][1] == "no_slot"
    update(("白鲢", "nap 3", 100))
    assert versions.latest() == 1
    after = ask(2)
    assert after[1][1] == "no_slot" and after[2] == ("白鲢", "not_found")
    update(("白鲢", "nha 4", 101), ("鲫鱼", "broken a b", 102))
    entries = {r["word"]: (r["tag"], r["freq"]) for r in versions.read(2).collect()}
    assert entries["白鲢"] == ("nha", 4) and entries["鲫鱼"] == ("nap", 0)
    assert ask(3)[3][1] == "no_slot"


def test_a_replayed_batch_uses_its_dictionary_again(spark, tmp_path):
    versions = DictionaryVersions.create(tables(spark)["dictionary"], str(tmp_path / "versions"))
    pins = str(tmp_path / "pins")
    assert versions.pinned(pins, 0) == 0
    update = spark.createDataFrame([("青鱼", "nap", 1)], UPDATE)
    versions.fold(update, 0)
    once = sorted(map(tuple, versions.read(1).collect()))
    assert (versions.pinned(pins, 0), versions.pinned(pins, 1), versions.latest()) == (0, 1, 1)
    versions.fold(update, 0)
    assert sorted(map(tuple, versions.read(1).collect())) == once
    assert versions.pinned(pins, 1) == 1
