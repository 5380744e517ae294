"""Hashed terms of texts for the linear and pairwise models, and the bounded sample that they are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphask.llm.textbytes import Words, in_small_batches, mixed, pieces

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
#: Kinds of bytes for word shapes: lower case (and all else above ASCII), capital, digit, mark.
_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91] = 1
_KIND[0x80:0x9F] = 1
_KIND[48:58] = 2
_KIND[_PUNCTUATION] = 3


class Terms(NamedTuple):
    """Distinct (document, term) pairs of a run of documents and how often each occurs."""

    doc: np.ndarray
    term: np.ndarray
    count: np.ndarray


def _counted(doc: np.ndarray, term: np.ndarray, buckets: int) -> Terms:
    pair, count = np.unique(doc.astype(np.int64) * buckets + term, return_counts=True)
    return Terms(pair // buckets, pair % buckets, count)


def bare(words: Words) -> Words:
    """The words in lower case (A-Z and the accented Latin-1 letters) without marks at their ends; others are left out."""
    data = _LOWER[words.data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[accented] += 32
    marked = np.flatnonzero(_PUNCTUATION[data[words.start]] | _PUNCTUATION[data[words.end - 1]])
    start, end = words.start.copy(), words.end.copy()
    if len(marked):
        # Places of the bytes that are no marks, closed by one beyond the text.
        letters = np.r_[np.flatnonzero(~_PUNCTUATION[data]), len(data)]
        start[marked] = letters[np.searchsorted(letters, words.start[marked])]
        end[marked] = np.where(
            start[marked] < words.end[marked], letters[np.searchsorted(letters, words.end[marked]) - 1] + 1, start[marked]
        )
    real = end > start
    return Words(data, start[real], end[real], words.doc[real], words.first, words.n_docs)


def word_terms(words: Words, buckets: int, prefixes: tuple[int, ...] = ()) -> Terms:
    """Bare words and, where a word is longer, its first bytes."""
    plain = bare(words)
    docs, terms = [plain.doc], [plain.hashes() % np.uint64(buckets)]
    size = plain.end - plain.start
    for width in prefixes:
        long = size > width
        head = Words(plain.data, plain.start[long], plain.start[long] + width, plain.doc[long], plain.first, plain.n_docs)
        docs.append(head.doc)
        terms.append(mixed(head.hashes() + np.uint64(width)) % np.uint64(buckets))
    return _counted(np.concatenate(docs), np.concatenate(terms).astype(np.int64), buckets)


def shape_terms(words: Words, buckets: int) -> Terms:
    """Shapes of the words: kinds of letters, the marks at both ends, and whether the word repeats the one before."""
    if not len(words.start):
        return _counted(words.doc, words.start, buckets)
    kinds = _KIND[words.data]
    code = np.zeros(len(words.start), dtype=np.int64)
    for kind in range(4):
        upto = np.r_[0, np.cumsum(kinds == kind)]
        code = code * 3 + np.minimum(upto[words.end] - upto[words.start], 2)
    for at in (words.start, words.end - 1):
        code = code * 256 + np.where(_PUNCTUATION[words.data[at]], words.data[at], 0)
    hashes = words.hashes()
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])]
    code = code * 2 + again
    return _counted(words.doc, (mixed(code.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)


def map_texts(
    docs: DataFrame, columns: list[str], added: T.StructType, per_piece: Callable[[Words], list[np.ndarray | pa.Array]]
) -> DataFrame:
    """``columns`` of the documents and what ``per_piece`` makes of each run of texts, in their partitions.

    A missing text is empty. Only one run of texts is expanded at a time.
    """
    schema = T.StructType([*(docs.schema[c] for c in columns), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [per_piece(words) for words in pieces(batch.column("_whole_text"))]
            if made:
                new = [pa.concat_arrays([m if isinstance(m, pa.Array) else pa.array(m) for m in parts]) for parts in zip(*made, strict=True)]
                kept = [batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema.fieldNames())

    texts = docs.select(*columns, F.col("text").cast("string").alias("_whole_text"))
    return in_small_batches(texts).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, allowed: Column, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents, those with the smallest hashes of their ids.

    Rows without an id or a label are not used; of several labels of a document the
    largest counts. The ids are chosen before any text is read, so the join's small side
    has at most ``rows`` rows.
    """
    chosen = (
        labels.select("doc_id", label.cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def listed(terms: Terms, n_docs: int, *extra: np.ndarray) -> list[pa.Array]:
    """Terms (and values beside them) as one list per document."""
    ends = np.searchsorted(terms.doc, np.arange(n_docs + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for values in (terms.term, *extra)]


def train_in_one_task(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes:
    """Fit on a sample of bounded size in a single task; the model comes back as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            table = pa.Table.from_batches(got)
            order = pc.sort_indices(table, [("doc_id", "ascending")])
            yield pa.RecordBatch.from_arrays([pa.array([fit(table.take(order))], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return row["model"] if row else b""


def flattened(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


class Adam:
    """Full-batch steps for a list of parameter arrays."""

    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.mean = [np.zeros_like(p) for p in parameters]
        self.square = [np.zeros_like(p) for p in parameters]

    def move(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, s in zip(self.parameters, gradients, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-8)
