import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphask.plans import broadcast_if_bounded, cut_lineage, find_hot_keys, measure, salted_join, skew


@pytest.fixture(scope="module")
def sides(spark):
    """One key holds a third of the rows."""
    many = spark.range(900).select(
        F.col("id"), F.when(F.col("id") < 300, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    one = spark.createDataFrame([("hot", 0)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    return many, one


def test_hot_keys_are_the_frequent_ones(spark, sides):
    many, _ = sides
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    hot = find_hot_keys(counts, ["k"], rows_per_task=100)
    assert [tuple(row) for row in hot.table.collect()] == [("hot", 3)]
    assert not find_hot_keys(counts, ["k"], rows_per_task=1000)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_gives_the_plain_join(spark, sides, how):
    many, one = sides
    hot = find_hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], rows_per_task=50)
    plain = sorted(tuple(r) for r in many.join(one, "k", how).select("id", "k", "v").collect())
    salted = salted_join(many, one, ["k"], hot, "id", how).select("id", "k", "v")
    assert sorted(tuple(r) for r in salted.collect()) == plain


def test_hot_key_is_spread_over_tasks(spark, sides):
    many, one = sides
    hot = find_hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], rows_per_task=50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(many, one, ["k"], hot, "id").where("k = 'hot'")
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_thousands_of_hot_keys_are_all_spread(spark):
    many = spark.range(60_000).select((F.col("id") % 3_000).alias("k"), "id")
    one = spark.range(3_000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    hot = find_hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], rows_per_task=5)
    assert hot.table.count() == 3_000 and {r[0] for r in hot.table.select("_n_salts").distinct().collect()} == {4}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(many, one, ["k"], hot, "id").withColumn("p", F.spark_partition_id())
        places = joined.groupBy("k").agg(F.countDistinct("p").alias("n"), F.count("*").alias("rows")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(places) == 3_000 and {r["rows"] for r in places} == {20}
    assert sum(r["n"] > 1 for r in places) > 2_900


def test_the_table_of_hot_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 10)
    counts = spark.createDataFrame([(i, 100 if i < 3 else 10) for i in range(100)], "k int, n long")
    hot = find_hot_keys(counts, ["k"], rows_per_task=5)
    assert hot.table.count() <= 10


def test_broadcast_only_within_bounds(spark, sides):
    _, one = sides
    assert measure(one).rows == 41
    assert broadcast_if_bounded(one)[1]
    assert not broadcast_if_bounded(one, max_rows=40)[1]
    assert not broadcast_if_bounded(one, max_bytes=10)[1]


def test_checkpoints_go_to_the_folder_of_the_session(spark, sides):
    many, _ = sides
    cut = cut_lineage(many.groupBy("k").count())
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
    assert "Range" not in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == 51


def test_lists_maps_and_structs_are_measured(spark):
    rows = spark.range(10).select(
        F.array_repeat(F.lit(0.5), 1000).alias("numbers"),
        F.array(F.lit("abc"), F.lit(None).cast("string")).alias("words"),
        F.create_map(F.lit("k"), F.lit(1)).alias("pairs"),
        F.struct(F.lit("xy").alias("s"), F.lit(1).alias("n")).alias("both"),
        F.lit(None).cast("array<double>").alias("none"),
    )
    assert measure(rows) == (10, 10 * (8000 + 3 + 1 + 8 + 2 + 8))


@pytest.mark.parametrize("most", [0, 1, 20, 1000])
def test_frequent_join_gives_the_plain_join(spark, sides, monkeypatch, most):
    many, one = sides
    many = many.unionByName(spark.createDataFrame([(1000, None), (1001, "k1")], "id long, k string"))
    one = one.unionByName(spark.createDataFrame([("k1", 77), ("hot", 78), (None, 79)], "k string, v int"))
    monkeypatch.setattr(skew, "FREQUENT_KEYS", most)
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.frequent_join(many, one, "k", counts, "id").select("id", "k", "v")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in many.join(one, "k").select("id", "k", "v").collect())


def test_hits_of_frequent_words_are_not_shuffled(spark, monkeypatch):
    """With a vocabulary beyond a broadcast only the rows of rare words meet it by a shuffle."""
    from graphask.operators import features, naive_bayes as nb

    texts = spark.range(400).select(
        F.col("id").alias("doc_id"), F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("rare"), F.col("id"))).alias("words")
    )
    words = texts.select(F.explode("words").alias("word")).distinct()
    vocabulary = cut_lineage(words.select("word", F.dense_rank().over(Window.orderBy("word")).alias("idx")))
    plain = sorted(map(tuple, features.feature_hits(texts, vocabulary, "doc_id").collect()))
    hits = cut_lineage(features.feature_hits(texts, vocabulary, "doc_id"))
    model = nb.NaiveBayesTable([0], [0.0], vocabulary.select("idx", F.array(F.col("idx") * 0.5).alias("theta")))
    scores = sorted(map(str, nb.score_table(model, texts, hits, "doc_id").collect()))
    monkeypatch.setattr(skew, "FREQUENT_KEYS", 4)
    for module in (features, nb):
        monkeypatch.setattr(module, "broadcast_if_bounded", lambda df, **_: (df, False))
    seen = []
    monkeypatch.setattr(skew, "salted_join", lambda many, *rest, join=skew.salted_join: seen.append(many.count()) or join(many, *rest))
    assert sorted(map(tuple, features.feature_hits(texts, vocabulary, "doc_id").collect())) == plain
    assert sorted(map(str, nb.score_table(model, texts, hits, "doc_id").collect())) == scores
    assert seen == [400, 400]
