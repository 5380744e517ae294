"""Multinomial naive Bayes as grouped aggregates.

Same parameters as ``pyspark.ml`` with smoothing 1, for any value features and
for labels that are not dense. Parameters stay a table of one row per
vocabulary entry, with one log-likelihood per class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphask.plans import broadcast_if_bounded, cut_lineage, frequent_join, stored

MAX_CLASSES = 10_000
SMOOTHING = 1.0


@dataclass(frozen=True)
class NaiveBayesTable:
    """Class labels, their log priors, and ``idx, theta array<double>``."""

    labels: list[Any]
    log_priors: list[float]
    theta: DataFrame

    def to_long(self) -> DataFrame:
        """``label, idx, log_theta, log_prior`` for every class and vocabulary entry."""
        labels = F.array(*[F.lit(label) for label in self.labels])
        priors = F.array(*[F.lit(prior) for prior in self.log_priors])
        return self.theta.select("idx", F.posexplode("theta").alias("k", "log_theta")).select(
            F.get(labels, "k").alias("label"), "idx", "log_theta", F.get(priors, "k").alias("log_prior")
        )


def class_counts(labelled: DataFrame, label: str = "label") -> dict[Any, int]:
    """Texts per class, in label order; the number of classes is checked."""
    counts = labelled.where(F.col(label).isNotNull()).groupBy(label).count()
    rows = counts.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not rows:
        raise ValueError("no training samples")
    return {row[label]: row["count"] for row in sorted(rows, key=lambda row: row[label])}


def fit_table(
    hits: DataFrame,
    labelled: DataFrame,
    vocabulary: DataFrame,
    label: str = "label",
    value: str | None = None,
) -> NaiveBayesTable:
    """Fit from ``hits`` (``label, idx[, value]``) and one ``labelled`` row per text."""
    per_class = class_counts(labelled, label)
    labels = list(per_class)
    amount = F.lit(1.0) if value is None else F.col(value)
    counts = cut_lineage(
        hits.groupBy("idx").agg(
            *[
                F.sum(F.when(F.col(label) == F.lit(k), amount).otherwise(F.lit(0.0))).alias(f"c{i}")
                for i, k in enumerate(labels)
            ]
        )
    )
    totals = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(labels))]).first()
    n_words = vocabulary.count()
    theta = [
        F.log(F.coalesce(f"c{i}", F.lit(0.0)) + SMOOTHING) - F.lit(math.log(totals[i] + SMOOTHING * n_words))
        for i in range(len(labels))
    ]
    n_texts = sum(per_class.values())
    log_priors = [
        math.log(per_class[k] + SMOOTHING) - math.log(n_texts + SMOOTHING * len(labels)) for k in labels
    ]
    table = vocabulary.select("idx").join(counts, "idx", "left").select("idx", F.array(*theta).alias("theta"))
    # Written once: the table is measured, joined and listed.
    return NaiveBayesTable(labels, log_priors, stored(table, "naive-bayes"))


def score_table(
    model: NaiveBayesTable,
    texts: DataFrame,
    hits: DataFrame,
    key: str,
    value: str | None = None,
) -> DataFrame:
    """``key, scores array<double>``: log joint per class; a text without hits keeps the priors."""
    amount = F.lit(1.0) if value is None else F.col(value)
    theta, bounded = broadcast_if_bounded(model.theta)
    if bounded:
        weighted = hits.join(theta, "idx")
    else:
        weighted = frequent_join(hits, theta, "idx", hits.groupBy("idx").agg(F.count("*").alias("n")), key)
    sums = weighted.groupBy(key).agg(
        *[F.sum(F.get("theta", F.lit(i)) * amount).alias(f"s{i}") for i in range(len(model.labels))]
    )
    scores = [F.lit(p) + F.coalesce(f"s{i}", F.lit(0.0)) for i, p in enumerate(model.log_priors)]
    return texts.select(key).join(sums, key, "left").select(key, F.array(*scores).alias("scores"))


def argmax_label(model: NaiveBayesTable, scores: Column) -> Column:
    """The label with the highest score; the smallest label wins a tie."""
    labels = F.array(*[F.lit(label) for label in model.labels])
    return F.get(labels, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def probabilities(scores: Column) -> Column:
    """Posterior of every class (log-sum-exp)."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)
