from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphask import QuestionEngine, aquaculture_catalog
from graphask.operators.graph import Graph
from graphask.plans import find_hot_keys, long_texts
from graphask.plans.long_texts import join_long_texts

HUBS, MEMBERS, QUESTIONS = 40, 1000, 2000


class Asked(QuestionEngine):
    """Takes tables that are analysed already: ``question_id, template_id, slot1, slot2, slot_name``."""

    def _ask(self, questions):
        return questions, questions.groupBy("template_id", "slot_name").agg(F.count(F.lit(1)).alias("n"))


@pytest.fixture(scope="module")
def graph(spark):
    props = F.lit(None).cast("map<string,string>").alias("props")
    hub = F.concat(F.lit("h"), F.col("id").cast("string"))
    hubs = spark.range(HUBS).select(F.col("id").alias("node_id"), F.lit("栖息地").alias("label"), hub.alias("name"), props)
    members = spark.range(HUBS, HUBS + HUBS * MEMBERS)
    fish = members.select(
        F.col("id").alias("node_id"), F.lit("水产品").alias("label"), F.md5(F.col("id").cast("string")).alias("name"), props
    )
    edges = members.select(F.col("id").alias("src_id"), F.lit("栖息于").alias("rel"), (F.col("id") % HUBS).alias("dst_id"))
    return Graph(hubs.unionByName(fish), edges)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 20])
def test_long_answers_are_written_once_a_file(spark, tmp_path, graph, rows_per_task):
    """40 lists of 35 kB, 50 questions each: 70 MB of answers, 1.4 MB of different ones."""
    name = F.concat(F.lit("h"), (F.col("id") % (HUBS + 1)).cast("string"))
    asked = spark.range(QUESTIONS).select(
        F.col("id").alias("question_id"), F.lit(23).alias("template_id"), name.alias("slot1"), F.lit("栖息于").alias("slot2"),
        name.alias("slot_name"),
    )
    engine = Asked(graph, aquaculture_catalog(), None, None, rows_per_task=rows_per_task)
    engine.answer(asked).write.parquet(str(tmp_path / "out"))
    written = sum(path.stat().st_size for path in (tmp_path / "out").glob("*.parquet"))
    assert written < (3 if rows_per_task > 20 else 8) * HUBS * MEMBERS * 35

    got = spark.read.parquet(str(tmp_path / "out"))
    names = graph.nodes.where("label = '水产品'").select((F.col("node_id") % HUBS).alias("hub"), "name")
    lists = {r["hub"]: sorted(r["names"]) for r in names.groupBy("hub").agg(F.collect_list("name").alias("names")).collect()}
    digests = {r["question_id"]: r for r in got.withColumn("answer", F.md5("answer")).collect()}
    assert len(digests) == got.count() == QUESTIONS
    expected = spark.createDataFrame([(hub, "、".join(found)) for hub, found in lists.items()], "hub long, answer string")
    expected = {r["hub"]: r["answer"] for r in expected.withColumn("answer", F.md5("answer")).collect()}
    for question_id, row in digests.items():
        hub = question_id % (HUBS + 1)
        if hub < HUBS:
            assert (row["answer"], row["match_count"], row["status"]) == (expected[hub], MEMBERS, "ok")
        else:
            assert row["status"] == "not_found"


def _tables(spark):
    """Keys with 0 to 60 rows, repeated and null ids, null and unmatched keys; texts null, short and long, in two parts."""
    asks = [(t, f"s{s}") for t in range(3) for s in range(12)]
    many = [(i if i % 7 else None, *asks[(i * i) % 36], part) for i in range(600) for part in (0, 1)] * 2
    many += [(1, None, "s1", 0), (2, 1, None, 0), (3, 9, "s1", 0)]
    lengths = (None, 0, 5, 30, 200, 900)
    one = [
        (t, s, part, None if (length := lengths[(i + part) % 6]) is None else f"{t}{s}{part}".ljust(length, "x"))
        for i, (t, s) in enumerate(asks) for part in (0, 1)
    ]
    one += [(None, "s1", 0, "n" * 900), (1, None, 0, "n" * 900)]
    return (
        spark.createDataFrame(many, "question_id long, t int, s string, part int"),
        spark.createDataFrame(one, "t int, s string, part int, text string"),
    )


@pytest.mark.parametrize("rows_per_task", [1_000_000, 50, 3])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 2000, 10])
def test_rows_are_those_of_the_join(spark, monkeypatch, rows_per_task, broadcast_bytes):
    """In one broadcast, in several, and with more bytes than are broadcast."""
    monkeypatch.setattr(long_texts, "BYTES_PER_TASK", 1000)
    many, one = _tables(spark)
    counts = many.groupBy("t", "s").agg(F.count(F.lit(1)).alias("n"))
    hot = find_hot_keys(counts, ["t", "s"], rows_per_task=rows_per_task)
    keys = ["t", "s", "part"]
    joined = join_long_texts(many, one, keys, "text", counts, hot, "question_id", rows_per_task, 20, broadcast_bytes)
    columns = ["question_id", *keys, "text"]
    got = joined.select(*columns, F.spark_partition_id().alias("task")).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter(map(tuple, many.join(one, keys).select(*columns).collect()))
    if broadcast_bytes > 10:
        tasks = {}
        for row in got:
            if row["text"] and len(row["text"]) > 20:
                tasks.setdefault(row["task"], set()).add(row["text"])
        assert all(len(texts) == 1 or sum(map(len, texts)) <= 1500 for texts in tasks.values())
