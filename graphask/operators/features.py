"""Binary bag-of-words features, as sparse vectors and as a long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphask.functions import text as tx
from graphask.operators.tagging import NO_VARIANTS, Lexicon, match_spans
from graphask.plans import broadcast_if_bounded, cut_lineage, frequent_join

MAX_VOCABULARY = 1 << 18


def vocabulary_words(
    vocabulary: DataFrame,
    variants: tuple[str, str] = NO_VARIANTS,
    max_words: int = MAX_VOCABULARY,
) -> list[str]:
    """The words in index order, on the driver; a vocabulary over ``max_words`` is refused."""
    rows = vocabulary.select("idx", tx.normalize(F.col("word"), variants).alias("word")).limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"the vocabulary is over the limit of {max_words} words")
    return [row["word"] for row in sorted(rows, key=lambda row: row["idx"])]


def vectorize(
    df: DataFrame,
    words: Sequence[str],
    words_col: str = "words",
    features_col: str = "features",
    binary: bool = True,
) -> DataFrame:
    """Sparse presence (or count) vectors; words outside the vocabulary are dropped. No shuffle."""
    model = CountVectorizerModel.from_vocabulary(
        list(words), inputCol=words_col, outputCol=features_col, minTF=1.0, binary=binary
    )
    return model.transform(df)


def feature_hits(
    df: DataFrame,
    vocabulary: DataFrame,
    key: str,
    words_col: str = "words",
    binary: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Long form ``key, *carry, idx[, value]``: the vocabulary words each text holds.

    Presence needs no shuffle (one text is one row); counts are combined map-side.
    """
    words = F.array_distinct(words_col) if binary else F.col(words_col)
    exploded = df.select(key, *carry, F.explode(words).alias("word"))
    entries = vocabulary.select("word", "idx")
    entries, bounded = broadcast_if_bounded(entries)
    if bounded:
        hits = exploded.join(entries, "word")
    else:
        hits = frequent_join(exploded, entries, "word", exploded.groupBy("word").agg(F.count("*").alias("n")), key)
    if binary:
        return hits.select(key, *carry, "idx")
    return hits.groupBy(key, *carry, "idx").agg(F.count("*").cast("double").alias("value"))


def sample_words(samples: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """``label, sentence, weight, words``: distinct phrasings, their copies counted as weight.

    With a lexicon the phrasings are tagged exactly like questions.
    """
    weighted = samples.groupBy("label", "sentence").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if lexicon is None:
        return weighted.withColumn("words", tx.tokenize(F.col("sentence")))
    matched = match_spans(weighted.select("sentence").distinct(), lexicon, key="sentence", text="sentence")
    words = matched.select("sentence", tx.merge_words(F.col("tokens"), F.col("spans")).alias("words"))
    return weighted.join(words, "sentence").select("label", "sentence", "weight", "words")


def labeled_points(samples: DataFrame, words: Sequence[str], lexicon: Lexicon | None = None) -> DataFrame:
    """``label, sentence, weight, features`` of a training corpus; raises when it is empty.

    Trainers pass over their input several times, so the vectors are written once.
    """
    points = cut_lineage(vectorize(sample_words(samples, lexicon), words).drop("words"))
    if points.isEmpty():
        raise ValueError("no training samples")
    return points
