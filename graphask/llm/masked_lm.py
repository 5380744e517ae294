"""Masked pseudo-likelihood: a small network predicts every token from the words on both sides.

The softmax is factored: a word's class given its neighbours comes from the network, the
word given its class from the counts of the corpus. The most frequent words are classes of their own, all
others share classes by their endings. The counts of the most frequent words are sent to the tasks, those of all
other words, of which there may be any number, meet their tokens in a join. Two tokens to the left and two to the right select rows of four tables, whose
sum goes through a tanh layer to a softmax over the classes. A document's score is
the sum of the log probabilities of its tokens, each given its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphask.llm.hashed_text import Adam, bare, map_texts
from graphask.llm.textbytes import Words, in_small_batches, mixed, pieces
from graphask.plans.lineage import scratch_dir, stored

#: Words with a class of their own, classes of endings for all others, and words whose counts are sent to every task.
FREQUENT = 64
ENDINGS = 32
KNOWN = 16_384
CLASSES = FREQUENT + ENDINGS
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
#: Tokens that go through the network together, and batches whose gradients are scattered to the tables together.
BATCH = 4_096
SCATTER = 8
#: Groups of documents, by a hash; the sum of a group's gradients makes one step. Each document is in one group of each round.
STEPS = 48
ROUNDS = 1
RATE = 0.1
#: Encoded tokens (a byte each) in a file of a group, and files that a group has at least.
FILE_TOKENS = 1 << 24
LEAST_FILES = 6
#: Tasks that add up the gradients of the partitions before the driver does.
ADDERS = 4
#: Counts that a task gathers before it hands them on.
HELD_COUNTS = 1 << 20

_SHAPES = {
    "tables": (len(OFFSETS), CLASSES + 1, HIDDEN),
    "hidden": (HIDDEN,),
    # The last row is the bias.
    "out": (HIDDEN + 1, CLASSES),
}
_DIGIT_TO_ZERO = np.arange(256, dtype=np.uint64)
_DIGIT_TO_ZERO[48:58] = 48


def endings(plain: Words) -> np.ndarray:
    """The class of the last two bytes of each word, all digits being alike."""
    last = _DIGIT_TO_ZERO[plain.data[plain.end - 1]]
    before = _DIGIT_TO_ZERO[plain.data[np.maximum(plain.end - 2, plain.start)]]
    return (mixed(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the known words with their classes and log probabilities in these.

    Of each ending, the log of all counts in its class, and the mean log probability of a word that is not known.
    """

    hashes: np.ndarray
    classes: np.ndarray
    logs: np.ndarray
    masses: np.ndarray
    unknown: np.ndarray

    def split(self, plain: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class of every word; its log probability in the class, to which a rare word must add the log of its count; the rare
        words, which are all that are not known, and their hashes."""
        hashes, ending = plain.hashes(), endings(plain)
        classes, logs, rare = FREQUENT + ending, -self.masses[ending], np.ones(len(hashes), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = np.flatnonzero(self.hashes[at] == hashes)
            classes[known], logs[known], rare[known] = self.classes[at[known]], self.logs[at[known]], False
        places = np.flatnonzero(rare)
        return classes, logs, places, hashes[places]

    def look_up(self, plain: Words) -> tuple[np.ndarray, np.ndarray]:
        """Class of every word and its log probability in the class, without a join: where only the known words
        are at hand, as for texts outside the corpus, others have the mean of their ending. Documents of the corpus
        are scored by :func:`rare_logs`, with the count of every word."""
        classes, logs, rare, _ = self.split(plain)
        logs[rare] = self.unknown[classes[rare] - FREQUENT]
        return classes, logs


@dataclass(frozen=True)
class Tokens:
    """Classes of the tokens of some documents with marks (``CLASSES``) around each document; places and owners of tokens."""

    padded: np.ndarray
    place: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, classes: np.ndarray, sizes: np.ndarray) -> Tokens:
        reach = max(OFFSETS)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(classes)) + reach * (doc + 1)
        padded = np.full(len(classes) + reach * (len(sizes) + 1), CLASSES, np.uint8)
        padded[place] = classes
        return cls(padded, place, doc)

    def batches(self) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray]]]:
        """Runs of tokens: which, their classes and the classes at ``OFFSETS``."""
        for lo in range(0, len(self.place), BATCH):
            part = slice(lo, lo + BATCH)
            at = self.place[part]
            yield part, self.padded[at], [self.padded[at + offset] for offset in OFFSETS]


class Network:
    """Parameters as one vector, with views by name."""

    def __init__(self, vector: np.ndarray):
        self.vector, at = vector, 0
        self.views = {}
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            self.views[name] = vector[at : at + size].reshape(shape)
            at += size

    @classmethod
    def start(cls, share: np.ndarray) -> Network:
        """Small seeded weights and the corpus frequencies as bias."""
        size = sum(int(np.prod(shape)) for shape in _SHAPES.values())
        network = cls(np.random.default_rng(0).normal(0, 0.1, size).astype(np.float32))
        network.views["hidden"][:] = 0
        network.views["out"][-1] = np.log(share)
        return network

    def _forward(self, around: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden values and a one, exponentials of the logits (less the largest where they could overflow), and their sums."""
        v = self.views
        hidden = np.ones((len(around[0]), HIDDEN + 1), np.float32)
        pre = np.take(v["tables"][0], around[0], axis=0)
        for table, near in zip(v["tables"][1:], around[1:], strict=True):
            pre += np.take(table, near, axis=0)
        pre += v["hidden"]
        np.tanh(pre, out=hidden[:, :HIDDEN])
        logits = hidden @ v["out"]
        if np.abs(v["out"]).sum(axis=0).max() > 80:
            logits -= logits.max(axis=1, keepdims=True)
        exps = np.exp(logits, out=logits)
        return hidden, exps, exps @ np.ones(CLASSES, np.float32)

    def log_likelihoods(self, tokens: Tokens) -> np.ndarray:
        """Log probability of the class of every token."""
        out = np.empty(len(tokens.place))
        for part, ids, around in tokens.batches():
            _, exps, sums = self._forward(around)
            out[part] = np.log(np.maximum(exps[np.arange(len(ids)), ids] / sums, 1e-30))
        return out

    def gradient(self, tokens: Tokens) -> np.ndarray:
        """Sum over all tokens of the gradient of the negative log likelihood, as one vector."""
        total = Network(np.zeros(len(self.vector)))
        into_hidden = np.ascontiguousarray(self.views["out"][:HIDDEN].T)
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []

        def scatter() -> None:
            inner = np.concatenate([each for each, _ in held])
            total.views["hidden"][:] += inner.sum(axis=0)
            for k, table in enumerate(total.views["tables"]):
                near = np.concatenate([around[k] for _, around in held])
                order = np.argsort(near, kind="stable")
                near = near[order]
                first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
                table[near[first]] += np.add.reduceat(np.take(inner, order, axis=0), first)
            held.clear()

        for _, ids, around in tokens.batches():
            hidden, error, sums = self._forward(around)
            error[np.arange(len(ids)), ids] -= sums
            scale = (1 / sums)[:, None]
            total.views["out"][:] += (hidden * scale).T @ error
            held.append(((error @ into_hidden) * scale * (1 - hidden[:, :HIDDEN] ** 2), around))
            if len(held) == SCATTER:
                scatter()
        if held:
            scatter()
        return total.vector


def count_words(docs: DataFrame) -> DataFrame:
    """``hash, ending, n`` of every distinct word of all texts; counted in the partitions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            every = np.concatenate([h for h, _, _ in held])
            hashes, first, inverse = np.unique(every, return_index=True, return_inverse=True)
            ending = np.concatenate([e for _, e, _ in held])[first]
            counts = np.bincount(inverse, np.concatenate([n for _, _, n in held]), len(hashes)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(ending), pa.array(counts)], ["hash", "ending", "n"])

        for batch in batches:
            for words in pieces(batch.column(0)):
                plain = bare(words)
                hashes, first, counts = np.unique(plain.hashes(), return_index=True, return_counts=True)
                held.append((hashes, endings(plain)[first], counts))
            if sum(len(h) for h, _, _ in held) > HELD_COUNTS:
                yield merged()
                held = []
        if held:
            yield merged()

    texts = in_small_batches(docs.select(F.col("text").cast("string").alias("text")))
    return texts.mapInArrow(run, "hash long, ending long, n long").groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def fit_vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> tuple[Vocabulary, np.ndarray, int]:
    """The known words, the share of every class and the number of tokens, from the counts of the whole corpus.

    At most ``KNOWN`` words, the most frequent ones, come to the driver. ``counts`` is the stored
    :func:`count_words` of the documents, where a caller needs it too.
    """
    counts = stored(count_words(docs), "lm-counts") if counts is None else counts
    top = counts.orderBy(F.desc("n"), "hash").limit(KNOWN).toPandas()
    n, ending = top["n"].to_numpy(np.int64), top["ending"].to_numpy(np.int64)
    classes = np.where(np.arange(len(top)) < FREQUENT, np.arange(len(top)), FREQUENT + ending)
    mass, distinct = np.zeros(CLASSES), np.zeros(ENDINGS)
    for row in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("n").alias("words")).collect():
        mass[FREQUENT + row["ending"]], distinct[row["ending"]] = row["n"], row["words"]
    tokens = int(mass.sum())
    mass[FREQUENT:] -= np.bincount(ending[:FREQUENT], n[:FREQUENT], ENDINGS)
    mass[: len(n[:FREQUENT])] = n[:FREQUENT]
    distinct -= np.bincount(ending, minlength=ENDINGS)
    rest = mass[FREQUENT:] - np.bincount(ending[FREQUENT:], n[FREQUENT:], ENDINGS)
    unknown = np.log(np.maximum(rest, 1) / np.maximum(mass[FREQUENT:], 1) / np.maximum(distinct, 1))
    logs, masses = np.log(n / mass[classes]), np.log(np.maximum(mass[FREQUENT:], 1))
    hashes = top["hash"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(hashes)
    share = (mass + 1) / (mass + 1).sum()
    return Vocabulary(hashes[order], classes[order], logs[order], masses, unknown), share.astype(np.float32), tokens


_ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("in_class", T.DoubleType()),
    T.StructField("classes", T.BinaryType()),
    T.StructField("rare", T.ArrayType(T.LongType())),
])


def encode(docs: DataFrame, vocabulary: Vocabulary, tokens: int) -> DataFrame:
    """``doc_id, row, n_tokens, in_class, classes, rare, step`` of every document, written once in groups by ``step``.

    ``classes`` holds a byte for each token, ``in_class`` the sum of the log probabilities of the words in
    their classes, without the counts of the rare words, whose hashes are in ``rare``. ``row`` numbers the rows, as ids may
    repeat. The group is a hash of the document, so it does not depend on partitions.
    """

    def per_piece(words: Words) -> list:
        plain = bare(words)
        classes, logs, rare, hashes = vocabulary.split(plain)
        ends = np.searchsorted(plain.doc, np.arange(words.n_docs + 1)).astype(np.int64)
        encoded = pa.Array.from_buffers(pa.large_binary(), words.n_docs, [None, pa.py_buffer(ends), pa.py_buffer(classes.astype(np.uint8))])
        inner = np.bincount(plain.doc, logs, words.n_docs).astype(float)
        upto = np.searchsorted(plain.doc[rare], np.arange(words.n_docs + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(hashes.astype(np.int64)))
        return [np.diff(ends), inner, encoded.cast(pa.binary()), lists]

    step = F.pmod(F.xxhash64("doc_id", "text"), F.lit(STEPS)).cast("int")
    keyed = docs.select("doc_id", "text", step.alias("step"), F.monotonically_increasing_id().alias("row"))
    files = max(LEAST_FILES, -(-tokens // (STEPS * FILE_TOKENS)))
    dealt = map_texts(keyed, ["doc_id", "step", "row"], _ENCODED, per_piece).withColumn("file", F.col("row") % files)
    path = scratch_dir(docs.sparkSession, "lm-encoded")
    dealt.repartition(STEPS * files, "step", "file").drop("file").write.partitionBy("step").parquet(path)
    row, group = T.StructField("row", T.LongType()), T.StructField("step", T.IntegerType())
    return docs.sparkSession.read.schema(T.StructType([docs.schema["doc_id"], row, *_ENCODED.fields, group])).parquet(path)


def rare_logs(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, rare_log``: the sum of the logs of the counts of all rare words of a document, for those that have any.

    Every rare word meets its own count, by its hash. No word is frequent here, as ``KNOWN`` words occur
    at least as often, so no key holds more than a small share of the tokens.
    """
    words = encoded.select("row", F.explode("rare").alias("hash")).groupBy("row", "hash").agg(F.count(F.lit(1)).alias("times"))
    met = words.join(counts.select("hash", F.log(F.col("n").cast("double")).alias("log")), "hash")
    return met.groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("rare_log"))


def _tokens(column: pa.Array) -> Tokens:
    data, ends = _bytes(column)
    return Tokens.of(data[ends[0] : ends[-1]], np.diff(ends))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a binary column and the offsets of each."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def _summed(gradients: DataFrame) -> tuple[int, np.ndarray] | None:
    """Tokens and sum of the gradients of all partitions, added up in a few tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            for count, blob in zip(batch.column("n").to_pylist(), batch.column("gradient").to_pylist(), strict=True):
                n, total = n + count, total + np.frombuffer(blob)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "gradient"])

    rows = gradients.repartition(ADDERS).mapInArrow(run, "n long, gradient binary").collect()
    if not rows:
        return None
    return sum(r["n"] for r in rows), np.sum([np.frombuffer(r["gradient"]) for r in rows], axis=0)


def fit_network(encoded: DataFrame, share: np.ndarray, rounds: int = ROUNDS) -> Network:
    """Steps of Adam, each on the gradient of one group of documents, summed over its partitions.

    Every token of every document is a target in every round. What reaches the driver is the sum, of the
    model's fixed size; as gradients and not models are added, the partitions matter by rounding only.
    """
    network = Network.start(share)
    vector = network.vector.astype(float)
    optimizer = Adam([vector], RATE)
    for number in range(rounds * STEPS):
        network = Network(vector.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], network: Network = network) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(len(network.vector))
            for batch in batches:
                tokens = _tokens(batch.column(0))
                total += network.gradient(tokens)
                n += len(tokens.place)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "gradient"])

        group = encoded.where(F.col("step") == number % STEPS).select("classes")
        found = _summed(group.mapInArrow(run, "n long, gradient binary"))
        if found:
            optimizer.rate = RATE * (1 - number / (rounds * STEPS))
            optimizer.move([found[1] / found[0]])
    return Network(vector.astype(np.float32))


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, per_token`` of every document ``doc_id, text``.

    A missing or empty text has no tokens, likelihood 0 and a null mean. Whole texts are read in their
    partitions; repeated rows score alike up to rounding; no documents give no rows; other columns are ignored.
    Every word has its own share of its class, by its count in the corpus.
    """
    counts = stored(count_words(docs), "lm-counts")
    vocabulary, share, tokens = fit_vocabulary(docs, counts)
    encoded = encode(docs, vocabulary, tokens)
    network = fit_network(encoded, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column("classes"))
            logs = np.bincount(tokens.doc, network.log_likelihoods(tokens), batch.num_rows).astype(float)
            total = logs + batch.column("in_class").to_numpy()
            kept = [batch.column(c) for c in ("doc_id", "row", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total)], schema.fieldNames())

    sums = [T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("frequent", T.DoubleType())]
    schema = T.StructType([docs.schema["doc_id"], *sums])
    scored = encoded.select("doc_id", "row", "n_tokens", "in_class", "classes").mapInArrow(run, schema)
    total = F.col("frequent") + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare_logs(encoded, counts), "row", "left").select(
        "doc_id",
        "n_tokens",
        total.alias("pseudo_log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"),
    )
