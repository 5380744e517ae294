"""Graded quality by a cumulative-link model: one weight per hashed term, ordered thresholds between the grades."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphask.llm.columns import held_out
from graphask.llm.hashed_text import (
    Adam,
    flattened,
    labelled_sample,
    listed,
    map_texts,
    shape_terms,
    train_in_one_task,
    word_terms,
)
from graphask.llm.textbytes import Words

#: Labelled rows that the model is fitted on at most.
LABELLED_ROWS = 10_000
WORD_BUCKETS = 1 << 16
SHAPE_BUCKETS = 1 << 12
GRADES = 3
STEPS = 200
RATE = 0.1
L2 = 1e-4


def grade() -> Column:
    """Grade of a label row: 0 for bad text, 1 for good but toxic text, 2 for good text."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))


def _features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and value: words by presence, shapes by their share of the words."""
    plain, shapes = word_terms(words, WORD_BUCKETS), shape_terms(words, SHAPE_BUCKETS)
    distinct = np.bincount(plain.doc, minlength=words.n_docs)
    length = np.bincount(words.doc, minlength=words.n_docs)
    doc = np.concatenate([plain.doc, shapes.doc])
    term = np.concatenate([plain.term, shapes.term + WORD_BUCKETS])
    value = np.concatenate([0.5 / np.sqrt(distinct[plain.doc]), 2.0 * np.sqrt(shapes.count / length[shapes.doc])])
    order = np.argsort(doc, kind="stable")
    return doc[order], term[order], value[order]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class OrdinalModel:
    """``P(grade <= k) = logistic(threshold[k] - sum(weight * value))``."""

    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """``P(grade > k)`` in column ``k``."""
        margin = np.bincount(doc, self.weights[term] * value, n_docs)
        return _logistic(margin[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, doc: np.ndarray, term: np.ndarray, value: np.ndarray, label: np.ndarray, grades: int) -> OrdinalModel:
        """Maximum likelihood with a ridge; gaps between thresholds are exponentials, so they stay ordered."""
        n = len(label)
        weights = np.zeros(WORD_BUCKETS + SHAPE_BUCKETS)
        below = np.array([(label <= k).sum() for k in range(grades - 1)])
        start = np.log((below + 0.5) / (n - below + 0.5))
        first, gaps = start[:1].copy(), np.log(np.maximum(np.diff(start), 0.05))
        optimizer = Adam([first, gaps, weights], RATE)
        for _ in range(STEPS):
            thresholds = first[0] + np.r_[0.0, np.cumsum(np.exp(gaps))]
            margin = np.bincount(doc, weights[term] * value, n)
            upto = np.c_[np.zeros(n), _logistic(thresholds[None, :] - margin[:, None]), np.ones(n)]
            rows = np.arange(n)
            low, high = upto[rows, label], upto[rows, label + 1]
            likelihood = np.maximum(high - low, 1e-9)
            pull = (1 - low - high) / n
            slope = np.zeros((n, grades + 1))
            slope[rows, label + 1] -= high * (1 - high) / likelihood / n
            slope[rows, label] += low * (1 - low) / likelihood / n
            by_threshold = slope[:, 1:-1].sum(axis=0)
            by_gap = np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(gaps)
            by_weight = np.bincount(term, pull[doc] * value, len(weights)) + L2 * weights
            optimizer.move([by_threshold.sum(keepdims=True), by_gap, by_weight])
        return cls(first[0] + np.r_[0.0, np.cumsum(np.exp(gaps))], weights)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, thresholds=self.thresholds, weights=self.weights.astype(np.float32))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes, grades: int) -> OrdinalModel:
        if not blob:
            return cls(np.linspace(-1.0, 1.0, grades - 1), np.zeros(WORD_BUCKETS + SHAPE_BUCKETS))
        with np.load(io.BytesIO(blob)) as saved:
            return cls(saved["thresholds"], saved["weights"].astype(float))


def fit_grades(docs: DataFrame, labels: DataFrame, grades: int = GRADES, rows: int = LABELLED_ROWS) -> OrdinalModel:
    """Learn from at most ``rows`` rows of ``labels`` (``doc_id, grade``) outside of the held-out fifth.

    Grades run from 0 to ``grades - 1``; other values are not used. Without labelled
    documents all thresholds are fixed and every text gets the same grade.
    """
    in_range = F.col("label").between(0, grades - 1)
    sample = labelled_sample(docs, labels, F.col("grade"), ~held_out() & in_range, rows)

    def features(words: Words) -> list:
        doc, term, value = _features(words)
        ends = pa.array(np.searchsorted(doc, np.arange(words.n_docs + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(ends, pa.array(column)) for column in (term, value)]

    added = T.StructType([T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
    listed_rows = map_texts(sample, ["doc_id", "label"], added, features)

    def fit(table: pa.Table) -> bytes:
        term, doc = flattened(table["terms"])
        value, _ = flattened(table["values"])
        label = table["label"].to_numpy().astype(np.int64)
        return OrdinalModel.fit(doc, term, value, label, grades).to_bytes()

    return OrdinalModel.from_bytes(train_in_one_task(listed_rows, fit), grades)


def grade_quality(docs: DataFrame, model: OrdinalModel, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (``doc_id`` unless given) of every document with ``expected_grade`` and ``tails``.

    ``tails[k]`` is the probability of a grade above ``k``. Whole texts are read in
    their partitions; a missing or empty text gets the grade of the thresholds alone.
    Repeated rows are graded alike; no documents give no rows.
    """

    def per_piece(words: Words) -> list:
        tails = model.tails(*_features(words), words.n_docs)
        ends = pa.array(np.arange(0, tails.size + 1, tails.shape[1], dtype=np.int32))
        return [tails.sum(axis=1), pa.ListArray.from_arrays(ends, pa.array(tails.ravel()))]

    added = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])
    return map_texts(docs, columns or ["doc_id"], added, per_piece)


def graded_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", grade().alias("grade"))


def quality_grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades of all documents from a model fitted on their labels; kept where grade 0 is the less likely half."""
    graded = grade_quality(docs, fit_grades(docs, graded_labels(labels)))
    return graded.select(
        "doc_id",
        held_out().alias("held_out"),
        "expected_grade",
        F.col("tails")[0].alias("p_above_0"),
        F.col("tails")[1].alias("p_above_1"),
        (F.col("tails")[0] >= 0.5).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose grade is above 0 with probability one half or more."""
    # The rows travel as one column, so no name of theirs can clash with those added.
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    graded = grade_quality(packed, fit_grades(docs, graded_labels(labels)), ["row"])
    return graded.where(F.col("tails")[0] >= 0.5).select("row.*")
