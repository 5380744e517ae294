"""Template classifiers on vectors: naive Bayes and a decision tree of Spark ML, multi-class boosted trees.

Scoring is one row in, one row out: no shuffle, no Python in the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    NaiveBayes,
    NaiveBayesModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphask.operators.features import vectorize
from graphask.operators import trees
from graphask.operators.naive_bayes import MAX_CLASSES, class_counts
from graphask.plans import broadcast_if_bounded

# Hyper-parameters of the classifiers; those of boosting are in ``trees``.
SMOOTHING = 1.0
TREE_IMPURITY = "entropy"
TREE_MAX_DEPTH = 16
TREE_MAX_BINS = 32
TRAIN_SHARE = 0.8

_LOADERS = {
    "naive_bayes": NaiveBayesModel,
    "decision_tree": DecisionTreeClassificationModel,
    "boosted": trees.BoostedTrees,
}


def in_training(key: Column, share: float = TRAIN_SHARE) -> Column:
    """Whether a row belongs to the training part.

    Decided by the digest of its key, so the split is the same after a retry,
    a repartitioning or a new run.
    """
    threshold = format(int(share * (1 << 32)), "08x")
    return F.substring(F.md5(key.cast("string")), 1, 8) < F.lit(threshold)


def split_by_key(df: DataFrame, key: str, share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Disjoint training and test parts."""
    part = in_training(F.col(key), share)
    return df.where(part), df.where(~part)


def positions(features_col: str) -> Column:
    """The sorted places of a vector that are not zero."""
    marked = F.transform(vector_to_array(features_col), lambda v, i: F.when(v != 0, i))
    return F.array_compact(marked)


@dataclass(frozen=True)
class TemplateClassifier:
    """A fitted model with the labels behind its dense class indexes and its vocabulary."""

    name: str
    model: Any
    labels: list[Any]
    words: list[str]

    def predict(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        """Add ``prediction`` (a label) and ``probability`` (``array<double>`` in label order)."""
        labels = F.array(*[F.lit(label) for label in self.labels])
        if isinstance(self.model, trees.BoostedTrees):
            scored = self.model.predict(df.withColumn("idxs", positions(features_col)))
            return scored.select(*df.columns, "prediction", "probability")
        scored = self.model.setFeaturesCol(features_col).setProbabilityCol("_posterior").transform(df)
        return scored.withColumn("probability", vector_to_array("_posterior")).select(
            *df.columns, F.get(labels, F.col("prediction").cast("int")).alias("prediction"), "probability"
        )

    def score(self, df: DataFrame, words_col: str = "words") -> DataFrame:
        """Predict from word arrays; adds ``n_hits`` and ``max_probability`` next to the prediction."""
        scored = self.predict(vectorize(df, self.words, words_col))
        present = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda acc, v: acc + v)
        return scored.withColumns(
            {"n_hits": present.cast("int"), "max_probability": F.array_max("probability")}
        ).drop("features")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        facts = json.dumps({"name": self.name, "labels": self.labels, "words": self.words}, ensure_ascii=False)
        spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.text(f"{path}/facts")
        self.model.save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TemplateClassifier:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        model = _LOADERS[facts["name"]].load(f"{path}/model")
        return cls(facts["name"], model, facts["labels"], facts["words"])


def _fit(name: str, estimator: Any, points: DataFrame, words: Sequence[str]) -> TemplateClassifier:
    labels = list(class_counts(points))
    index = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("label")) - 1
    weighted = "weight" in points.columns
    indexed = points.select(
        index.cast("double").alias("label"), "features", (F.col("weight") if weighted else F.lit(1.0)).alias("weight")
    )
    if weighted:
        estimator.setWeightCol("weight")
    return TemplateClassifier(name, estimator.fit(indexed), labels, list(words))


def fit_naive_bayes(points: DataFrame, words: Sequence[str]) -> TemplateClassifier:
    """Multinomial naive Bayes; ``points`` has ``label, features``, labels may have holes."""
    return _fit("naive_bayes", NaiveBayes(smoothing=SMOOTHING), points, words)


def fit_decision_tree(points: DataFrame, words: Sequence[str], seed: int = 0) -> TemplateClassifier:
    estimator = DecisionTreeClassifier(
        impurity=TREE_IMPURITY, maxDepth=TREE_MAX_DEPTH, maxBins=TREE_MAX_BINS, seed=seed
    )
    return _fit("decision_tree", estimator, points, words)


def fit_boosted(points: DataFrame, words: Sequence[str]) -> TemplateClassifier:
    """Boosted trees, one ensemble for all classes on the gradients of the multi-class loss."""
    weight = F.col("weight") if "weight" in points.columns else F.lit(1.0)
    model = trees.fit_boosted(points.select("label", weight.alias("weight"), positions("features").alias("idxs")))
    return TemplateClassifier("boosted", model, model.labels, list(words))


FITTERS: dict[str, Callable[..., TemplateClassifier]] = {
    "naive_bayes": fit_naive_bayes,
    "decision_tree": fit_decision_tree,
    "boosted": fit_boosted,
}


def accuracy(predictions: DataFrame, label: str = "label") -> DataFrame:
    """One row ``n_test, accuracy``: the share of predictions that equal the label, copies by weight."""
    weight = F.col("weight") if "weight" in predictions.columns else F.lit(1.0)
    hit = F.when(F.col("prediction") == F.col(label), weight).otherwise(0.0)
    return predictions.agg(
        F.sum(weight).cast("long").alias("n_test"), (F.sum(hit) / F.sum(weight)).alias("accuracy")
    )


def compare_models(models: Sequence[TemplateClassifier], test: DataFrame) -> DataFrame:
    """``model, n_test, accuracy`` per model, on vectors ``label, features``."""
    tables = [
        accuracy(model.predict(test)).select(F.lit(model.name).alias("model"), "n_test", "accuracy")
        for model in models
    ]
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def select_model(models: Sequence[TemplateClassifier], test: DataFrame) -> TemplateClassifier:
    """The most accurate model; the first listed wins a tie."""
    scores = {row["model"]: row["accuracy"] or 0.0 for row in compare_models(models, test).collect()}
    return max(models, key=lambda model: scores[model.name])


def compare_fitters(
    points: DataFrame, words: Sequence[str], names: Sequence[str] = tuple(FITTERS), key: str = "sentence"
) -> DataFrame:
    """``model, n_test, accuracy`` of the named trainers on one split of ``points`` by the digest of ``key``."""
    train, test = split_by_key(points, key)
    return compare_models([FITTERS[name](train, words) for name in names], test)


def best_fitter(compared: DataFrame) -> str:
    """The most accurate name of :func:`compare_fitters`; the first in the order of ``FITTERS`` wins a tie."""
    scores = {row["model"]: row["accuracy"] or 0.0 for row in compared.collect()}
    return max((name for name in FITTERS if name in scores), key=scores.__getitem__)


def lookup_templates(predictions: DataFrame, templates: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Add the ``pattern`` of the predicted template; a template set over the class limit is refused."""
    patterns, bounded = broadcast_if_bounded(
        templates.select(F.col("template_id").alias(prediction), "pattern"), max_rows=MAX_CLASSES
    )
    if not bounded:
        raise ValueError(f"more than {MAX_CLASSES} templates")
    return predictions.join(patterns, prediction, "left")

