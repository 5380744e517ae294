import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from aquaculture import tables
from graphask import schemas
from graphask.sources import (
    DICTIONARY_ORDER,
    props_from_columns,
    read_answers,
    read_dictionaries,
    read_dictionary,
    read_edges,
    read_nodes,
    read_questions,
    read_samples,
    read_templates,
    read_vocabulary,
    write_answers,
    write_edges,
    write_nodes,
)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_dictionary_file(spark, tmp_path):
    path = write(tmp_path / "d.txt", "草鱼\n鲤鱼 \n\n鲫鱼")
    got = {tuple(r) for r in read_dictionary(spark, path, "nap", 3).collect()}
    assert got == {("草鱼", "nap", 0, 3), ("鲤鱼", "nap", 0, 3), ("鲫鱼", "nap", 0, 3)}


def test_dictionaries_in_load_order(spark, tmp_path):
    paths = {tag: write(tmp_path / f"{tag}.txt", f"{tag}1\nshared") for tag in DICTIONARY_ORDER}
    got = {(r["word"], r["tag"]): r["load_order"] for r in read_dictionaries(spark, paths).collect()}
    assert len(got) == 14
    assert [got["shared", tag] for tag in DICTIONARY_ORDER] == list(range(7))


def test_indexed_files_with_byte_order_mark(spark, tmp_path):
    vocabulary = read_vocabulary(spark, write(tmp_path / "v.txt", "﻿0:nap\n1:别名\n"))
    assert [tuple(r) for r in vocabulary.orderBy("idx").collect()] == [(0, "nap"), (1, "别名")]
    templates = read_templates(spark, write(tmp_path / "t.txt", "﻿0:nap 别名\n1:养殖于 nve"))
    assert [tuple(r) for r in templates.orderBy("template_id").collect()] == [(0, "nap 别名"), (1, "养殖于 nve")]
    assert vocabulary.schema == schemas.VOCABULARY
    assert templates.schema == schemas.TEMPLATES


SECTIONS = """above the first header

===== 0 nap 别名 =====
old phrasing
===== 1 nap 特征 =====
b1

b2
===== 0 nap 别名 =====
a1
a2
"""


def test_sectioned_samples(spark, tmp_path):
    got = sorted(tuple(r) for r in read_samples(spark, write(tmp_path / "s.txt", SECTIONS)).collect())
    assert got == [(0, "a1"), (0, "a2"), (0, "above the first header"), (0, "old phrasing"), (1, "b1"), (1, "b2")]


def test_sections_of_all_files_count(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"{i}.txt", f"===== 0 x y =====\nzero {i}\n===== 1 x y =====\none {i}\n")
    got = sorted(tuple(r) for r in read_samples(spark, str(tmp_path)).collect())
    assert got == [(label, f"{word} {i}") for label, word in ((0, "zero"), (1, "one")) for i in range(3)]


def test_only_the_first_colon_cuts(spark, tmp_path):
    assert read_vocabulary(spark, write(tmp_path / "v.txt", "7:a:b\n")).first()["word"] == "a:b"


def test_section_that_spans_file_splits(spark, tmp_path):
    lines = ["===== 5 x y ====="] + [f"five {i}" for i in range(300)]
    lines += ["===== 2 x y ====="] + [f"two {i}" for i in range(300)]
    path = write(tmp_path / "s.txt", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        samples = read_samples(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = sorted(tuple(r) for r in samples.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([(5, f"five {i}") for i in range(300)] + [(2, f"two {i}") for i in range(300)])


def test_empty_corpus_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no training samples"):
        read_samples(spark, write(tmp_path / "s.txt", "\n\n"))


def test_null_marker_in_csv_nodes(spark, tmp_path):
    path = write(tmp_path / "n.csv", "node_id,label,name,别名\n1,水产品,草鱼,鲩鱼\n2,水产品,鲤鱼,\\N\n")
    got = {r["name"]: r["props"]["别名"] for r in read_nodes(spark, path, ["别名"], fmt="csv").collect()}
    assert got == {"草鱼": "鲩鱼", "鲤鱼": None}


def test_graph_tables_prune_partitions(spark, tmp_path):
    graph = tables(spark)
    write_nodes(graph["nodes"], str(tmp_path / "nodes"))
    write_edges(graph["edges"], str(tmp_path / "edges"))
    edges = read_edges(spark, str(tmp_path / "edges"), "成长")
    assert {(r["src_id"], r["dst_id"]) for r in edges.collect()} == {(7, 1), (9, 7)}
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel" in plan
    nodes = read_nodes(spark, str(tmp_path / "nodes"))
    assert nodes.where(F.col("label") == "疾病").count() == 1
    assert nodes.count() == graph["nodes"].count()


def test_wide_properties_scan_only_listed_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([(1, "l", "n", "a", "b", "c")], "node_id long, label string, name string, p string, q string, r string").write.parquet(path)
    nodes = read_nodes(spark, path, ["p", "q"])
    assert nodes.first()["props"] == {"p": "a", "q": "b"}
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "r:string" not in plan.split("ReadSchema")[1]
    assert props_from_columns(["p"]) is not None


def test_question_table(spark, tmp_path):
    path = str(tmp_path / "q")
    spark.createDataFrame([(1, "x")], schemas.QUESTIONS).write.json(path)
    assert read_questions(spark, path, "json").collect() == [(1, "x")]


def test_long_answers_are_stored_once_in_short_row_groups(spark, tmp_path):
    """Rows of a few bytes do not make a writer or reader hold thousands of long ones that follow."""
    long = F.concat((F.col("id") % 3).cast("string"), F.repeat(F.lit("n"), 50_000))
    answers = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") < 1000, F.lit("short")).otherwise(long).alias("answer"))
    write_answers(answers, str(tmp_path / "answers"))
    stored = [pq.ParquetFile(file).metadata for file in (tmp_path / "answers").glob("*.parquet")]
    groups = [meta.row_group(i) for meta in stored for i in range(meta.num_row_groups)]
    assert sum(group.num_rows for group in groups) == 3000 and max(group.num_rows for group in groups) <= 256
    assert max(group.total_byte_size for group in groups) < 1_000_000
    assert read_answers(spark, str(tmp_path / "answers")).exceptAll(answers).isEmpty()


def test_a_task_reads_one_file_of_answers(spark, tmp_path):
    """Twelve texts of 640 kB, each alone in a file: whoever writes them again meets one text a task."""
    number = F.col("id") % 12
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda i: F.md5(F.concat_ws("-", i, number))), "")
    answers = spark.range(0, 120, 1, 4).repartitionById(12, number.cast("int")).select("id", text.alias("answer"))
    path = str(tmp_path / "answers")
    write_answers(answers, path)
    got = read_answers(spark, path)
    dealt = got.select(F.spark_partition_id().alias("task"), F.input_file_name().alias("file")).distinct().collect()
    assert len(dealt) == len({row["task"] for row in dealt}) == 12
    got.write.parquet(str(tmp_path / "again"))
    assert sum(file.stat().st_size for file in (tmp_path / "again").glob("*.parquet")) < 12_000_000
    columns = ["id", F.md5("answer").alias("answer")]
    assert sorted(got.select(columns).collect()) == sorted(answers.select(columns).collect())
    got.createOrReplaceTempView("answers_of_one_file")
    assert spark.sql("SELECT count(*) AS n FROM answers_of_one_file").first()["n"] == 120


def test_a_long_answer_takes_little_room_in_each_row_group(spark, tmp_path):
    """A sorted list of 760 kB that 2 000 questions share: eight row groups hold it."""
    names = F.transform(F.sequence(F.lit(0), F.lit(900_000), F.lit(25)), lambda i: F.format_string("Customer#%09d", i))
    one = spark.range(1).select(F.array_join(names, "、").alias("answer"))
    write_answers(spark.range(0, 2000, 1, 1).join(F.broadcast(one)), str(tmp_path / "answers"))
    stored = [pq.ParquetFile(file).metadata for file in (tmp_path / "answers").glob("*.parquet")]
    groups = [meta.row_group(i) for meta in stored for i in range(meta.num_row_groups)]
    answers = [group.column(1) for group in groups]
    assert [column.path_in_schema for column in answers] == ["answer"] * 8
    assert sum(column.total_uncompressed_size for column in answers) > 8 * 750_000
    assert sum(column.total_compressed_size for column in answers) < 8 * 75_000
    assert all(group.column(0).is_stats_set and not group.column(1).is_stats_set for group in groups)
    found = read_answers(spark, str(tmp_path / "answers")).groupBy(F.md5("answer").alias("answer")).count().collect()
    assert found == one.select(F.md5("answer").alias("answer"), F.lit(2000).alias("count")).collect()
