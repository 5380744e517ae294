"""Toxicity by a factorization machine over hashed terms.

Besides a weight for each term, every term has a short vector, and the product of two
vectors weighs the pair: an insult next to a group mention can score high although
neither does alone.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphask.llm.columns import held_out
from graphask.llm.hashed_text import (
    Adam,
    flattened,
    labelled_sample,
    listed,
    map_texts,
    train_in_one_task,
    word_terms,
)
from graphask.llm.textbytes import Words

#: Labelled rows that the model is fitted on at most.
LABELLED_ROWS = 20_000
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
FACTORS = 8
#: Terms with a weight: the most telling ones, in this many documents at least, whose share of toxic ones differs by a factor.
TERMS = 4_096
LEAST_DOCUMENTS = 8
LEAST_LIFT = 1.8
LEAST_CHI_SQUARE = 25.0
SHRINK = 10.0
STEPS = 300
RATE = 0.02
L2_WEIGHT, L2_FACTOR = 1e-6, 1e-4


@dataclass(frozen=True)
class FactorizationMachine:
    """Sorted hashed terms with their weights and vectors."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        """Probability for each document from its distinct terms; unknown terms weigh nothing."""
        return 1 / (1 + np.exp(-np.clip(self._margins(*self._known(doc, term), n_docs)[0], -30, 30)))

    def _known(self, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return doc[:0], doc[:0]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        return doc[hit], at[hit]

    def _margins(self, doc: np.ndarray, at: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([np.bincount(doc, self.factors[at, k], n_docs) for k in range(self.factors.shape[1])], axis=1)
        squares = np.bincount(doc, (self.factors[at] ** 2).sum(axis=1), n_docs)
        pairs = ((sums**2).sum(axis=1) - squares) / 2
        return self.bias + np.bincount(doc, self.weights[at], n_docs) + pairs, sums

    @classmethod
    def fit(cls, doc: np.ndarray, term: np.ndarray, label: np.ndarray) -> FactorizationMachine:
        """Logistic loss over all documents; the start is seeded, so equal samples give equal models."""
        n, positive = len(label), label.sum()
        ids, inverse = np.unique(term, return_inverse=True)
        have = np.bincount(inverse, minlength=len(ids)).astype(float)
        toxic = np.bincount(inverse, label[doc], len(ids))
        base = positive / max(n, 1)
        share = (toxic + base) / (have + 1)
        spread = np.maximum(have * base * (1 - base) * (1 - have / max(n, 1)), 1e-9)
        chi_square = (toxic - have * base) ** 2 / spread
        lift = np.maximum(share / max(base, 1e-9), (1 - share) / max(1 - base, 1e-9))
        often = have >= LEAST_DOCUMENTS
        telling = np.flatnonzero(often & (chi_square >= LEAST_CHI_SQUARE) & (lift >= LEAST_LIFT))
        telling = np.sort(telling[np.argsort(-chi_square[telling], kind="stable")[:TERMS]])
        start = np.random.default_rng(0).normal(0, 0.02, (len(telling), FACTORS))
        bias = np.array([np.log((positive + 0.5) / (n - positive + 0.5))])
        # Weights start at shrunken log odds: loss alone stops short on terms that always come with other telling ones.
        seen, bad = have[telling] + SHRINK, toxic[telling] + SHRINK * base
        weights = np.log(bad / np.maximum(seen - bad, 1e-9)) - bias[0]
        model = cls(ids[telling], float(bias[0]), weights, start)
        doc, at = model._known(doc, term)
        if not len(at):
            return model
        optimizer = Adam([bias, model.weights, model.factors], RATE)
        for _ in range(STEPS):
            model = cls(model.terms, float(bias[0]), model.weights, model.factors)
            margin, sums = model._margins(doc, at, n)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / n
            own = error[doc]
            pull = sums[doc] - model.factors[at]
            by_factor = [np.bincount(at, own * pull[:, k], len(telling)) for k in range(FACTORS)]
            optimizer.move([
                np.array([error.sum()]),
                np.bincount(at, own, len(telling)) + L2_WEIGHT * model.weights,
                np.stack(by_factor, axis=1) + L2_FACTOR * model.factors,
            ])
        return cls(model.terms, float(bias[0]), model.weights, model.factors)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, terms=self.terms, bias=self.bias, weights=self.weights, factors=self.factors)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> FactorizationMachine:
        if not blob:
            return cls(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
        with np.load(io.BytesIO(blob)) as saved:
            return cls(saved["terms"], float(saved["bias"]), saved["weights"], saved["factors"])


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    found = word_terms(words, BUCKETS, PREFIXES)
    return found.doc, found.term


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> FactorizationMachine:
    """Learn from at most ``rows`` rows of ``labels`` (``doc_id, toxic``) outside of the held-out fifth.

    Without labelled documents every score is one half.
    """
    sample = labelled_sample(docs, labels, F.col("toxic"), ~held_out(), rows)

    def terms(words: Words) -> list:
        return listed(word_terms(words, BUCKETS, PREFIXES), words.n_docs)

    added = T.StructType([T.StructField("terms", T.ArrayType(T.LongType()))])
    features = map_texts(sample, ["doc_id", "label"], added, terms)

    def fit(table: pa.Table) -> bytes:
        term, doc = flattened(table["terms"])
        label = table["label"].to_numpy().astype(float)
        return FactorizationMachine.fit(doc, term, label).to_bytes()

    return FactorizationMachine.from_bytes(train_in_one_task(features, fit))


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id, score`` of every document ``doc_id, text``, from the whole text, in their partitions.

    A missing or empty text scores the base rate. Repeated rows score alike; no
    documents give no rows; other columns are ignored.
    """

    def per_piece(words: Words) -> list:
        return [model.scores(*_terms(words), words.n_docs)]

    return map_texts(docs, ["doc_id"], T.StructType([T.StructField("score", T.DoubleType())]), per_piece)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, in cases as ``score_toxicity`` says.

    A missing id is not held out; without labels every score is one half and ``predicted`` is 1.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
