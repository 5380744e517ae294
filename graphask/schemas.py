"""Typed schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

DICTIONARY = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("freq", T.IntegerType()),
    T.StructField("load_order", T.LongType()),
])

VOCABULARY = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("word", T.StringType()),
])

TEMPLATES = T.StructType([
    T.StructField("template_id", T.IntegerType()),
    T.StructField("pattern", T.StringType()),
])

SAMPLES = T.StructType([
    T.StructField("label", T.IntegerType()),
    T.StructField("sentence", T.StringType()),
])

NODES = T.StructType([
    T.StructField("node_id", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("props", T.MapType(T.StringType(), T.StringType())),
])

EDGES = T.StructType([
    T.StructField("src_id", T.LongType()),
    T.StructField("rel", T.StringType()),
    T.StructField("dst_id", T.LongType()),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("text", T.StringType()),
])
