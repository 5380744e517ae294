from pyspark.sql import functions as F

from graphask.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_five_spellings_share_one_key(spark):
    spellings = ["爱听4g", "爱听4G", "爱听４G", "爱听４Ｇ", "愛聽４Ｇ"]
    df = spark.createDataFrame([(s,) for s in spellings], ["t"])
    keys = {r[0] for r in df.select(tx.normalize(F.col("t"), ("愛聽", "爱听"))).collect()}
    assert keys == {"爱听4g"}


def test_tokens_of_both_scripts(spark):
    assert one(spark, tx.tokenize(F.col("t")), t="Who is Customer#000000001, in NATION_0?") == [
        "who", "is", "customer#000000001", "in", "nation_0",
    ]
    assert one(spark, tx.tokenize(F.col("t")), t="爱听４Ｇ的nap，吃什么？") == [
        "爱", "听", "4g", "的", "nap", "吃", "什", "么",
    ]
    assert one(spark, tx.tokenize(F.col("t")), t="  ...  ") == []


def test_ngrams_and_their_places(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    place = tx.ngram_place(F.col("p"), F.size("t"), [1, 2])
    rows = (
        df.select("t", F.posexplode(tx.ngrams(F.col("t"), [1, 2])).alias("p", "g"))
        .withColumn("place", place)
        .select("g", "place.start", "place.len")
        .collect()
    )
    assert sorted(tuple(r) for r in rows) == [
        ("a", 0, 1), ("a", 0, 1), ("a b", 0, 2), ("b", 1, 1), ("b c", 1, 2), ("c", 2, 1),
    ]


def test_long_fold_keeps_every_hit(spark):
    hits = [(i, -1, 1, f"w{i}", "t") for i in range(300)]
    schema = "h array<struct<start:int,neg_len:int,len:int,word:string,tag:string>>"
    df = spark.createDataFrame([(hits,)], schema)
    kept = df.select(tx.leftmost_longest(F.col("h"))).first()[0]
    assert [tuple(k) for k in kept] == hits


def test_mentions_and_filling(spark):
    terms = [(0, "a fish", "nap"), (1, "and", None), (2, "b fish", "nap"), (3, "fry", "napl")]
    df = spark.createDataFrame([(terms, "napl of nap x")], "t array<struct<pos:int,word:string,tag:string>>, p string")
    mentions = tx.mention_map(F.col("t"))
    row = df.select(
        mentions.alias("m"), tx.fill_template(F.col("p"), mentions).alias("f"), tx.abstract_text(F.col("t")).alias("a")
    ).first()
    assert row["m"] == {"nap": "b fish", "napl": "fry"}
    assert row["f"] == ["fry", "of", "b fish", "x"]
    assert row["a"] == "nap and nap napl"
