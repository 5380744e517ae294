from pyspark.sql import functions as F

from graphask import schemas
from graphask.operators import dictionary as di


def dictionary(spark, rows):
    return spark.createDataFrame(rows, schemas.DICTIONARY)


def updates(spark, rows):
    return spark.createDataFrame(rows, "word string, attr string, load_order long")


def rows_of(df):
    return {r["word"]: (r["tag"], r["freq"]) for r in df.collect()}


def test_parse_attribute(spark):
    df = spark.createDataFrame([("nz 10",), ("nz",), ("nz 1 x",), ("nz ten",)], ["a"])
    got = [tuple(r["p"]) for r in df.select(di.parse_attribute(F.col("a")).alias("p")).collect()]
    assert got == [("nz", 10, True), ("nz", 1, False), (None, None, False), (None, None, False)]


def test_add_keeps_present_words(spark):
    base = dictionary(spark, [("w", "a", 3, 0)])
    more = dictionary(spark, [("w", "b", 1, 1), ("v", "c", 2, 2), ("v", "d", 2, 1)])
    assert rows_of(di.add_words(base, more)) == {"w": ("a", 3), "v": ("d", 2)}


def test_upsert_resets_tag_and_frequency(spark):
    base = dictionary(spark, [("海尔", "nz", 20, 0), ("same", "x", 5, 0)])
    got = rows_of(di.upsert_words(base, updates(spark, [("海尔", "nb 0", 1), ("new", "q 4", 1), ("new", "r 5", 2)])))
    assert got == {"海尔": ("nb", 0), "same": ("x", 5), "new": ("q", 4)}


def test_malformed_upsert_resets_only_the_frequency(spark):
    base = dictionary(spark, [("w", "nz", 20, 0)])
    assert rows_of(di.upsert_words(base, updates(spark, [("w", "a b c", 1)]))) == {"w": ("nz", 0)}


def test_conflicts(spark):
    base = dictionary(spark, [("无节幼体", "napl", 0, 6), ("无节幼体", "nba", 0, 1), ("草鱼", "nap", 0, 0)])
    conflict = di.dictionary_conflicts(base).first()
    assert (conflict["word"], conflict["n_tags"], conflict["tags"], conflict["kept_tag"]) == (
        "无节幼体", 2, ["napl", "nba"], "nba",
    )
    assert rows_of(di.resolve_conflicts(base)) == {"无节幼体": ("nba", 0), "草鱼": ("nap", 0)}
