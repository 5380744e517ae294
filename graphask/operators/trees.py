"""Decision trees and multi-class boosting over binary features of any number, as grouped aggregates.

A text is one row with the sorted numbers of its words (``idxs``), so a vocabulary needs
no width. A level of a tree is one aggregate over (node, word): the weights of the texts that
have the word, by class, summed with numpy in the partitions first. Those of the texts
without it are the node's total minus these. The ``COMMON`` words come first. What a word
can gain at most follows from its weight in all texts, so the rarer ones are only summed at
nodes where they could still win. Only chosen splits leave the executors.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphask.operators.naive_bayes import class_counts
from graphask.plans.lineage import stored

# Hyper-parameters of the classifiers.
TREE_DEPTH = 16
BOOST_ROUNDS = 10
BOOST_RATE = 0.1
BOOST_DEPTH = 5
#: Weight of the pull of a leaf's values towards zero.
LEAF_PULL = 3.0
#: Scores are compared up to so many digits, so that sums in another order choose the same split.
DIGITS = 9
ROOT = 1
#: Words that are summed at every node, and words whose weight is known when it is asked which others could win.
COMMON = 4_096
RANKED = 1 << 17
#: Words and cells (texts by words that trees ask for) that a task holds at a time, and sums it keeps as a dense array.
CHUNK_WORDS = 1 << 22
CHUNK_CELLS = 1 << 26
DENSE_SUMS = 1 << 23
#: Sums that a task gathers before it adds up those of equal words.
HELD_SUMS = 1 << 22
#: Share of all weight up to which a node is searched for all words at once.
SMALL = 1 / 64


def sparse_points(hits: DataFrame, labelled: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """``key, label, weight, idxs``: a row for each labelled text with the sorted numbers of its words.

    ``hits`` is the long form ``key, idx``; a text without hits has an empty list. The
    width is unbounded, a list is as long as its text has different words.
    """
    lists = hits.groupBy(key).agg(F.sort_array(F.collect_set("idx")).alias("idxs"))
    amount = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = labelled.select(key, "label", amount.alias("weight")).join(lists, key, "left")
    none = F.array().cast(lists.schema["idxs"].dataType)
    return rows.select(key, "label", "weight", F.coalesce("idxs", none).alias("idxs"))


def _summed(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


@dataclass(frozen=True)
class DecisionTree:
    """``nodes``: ``node, depth, idx, prediction, counts`` with a null ``idx`` at leaves; the children of ``n`` are ``2n`` and ``2n + 1``."""

    labels: list[Any]
    nodes: DataFrame
    depth: int
    name: str = "decision_tree"

    def predict(self, points: DataFrame) -> DataFrame:
        """Add ``prediction``; a level of the tree is a join with its nodes, at most ``2 ** depth`` rows, without a shuffle."""
        walked = points.withColumn("_node", F.lit(ROOT).cast("long")).withColumn("_end", F.lit(None).cast("long"))
        for depth in range(self.depth + 1):
            level = self.nodes.where(F.col("depth") == depth).select(F.col("node").alias("_node"), F.col("idx").alias("_idx"))
            walked = walked.join(F.broadcast(level), "_node", "left")
            at_leaf = F.col("_end").isNull() & F.col("_idx").isNull()
            walked = walked.withColumn("_end", F.when(at_leaf, F.col("_node")).otherwise(F.col("_end")))
            child = 2 * F.col("_node") + F.array_contains("idxs", F.col("_idx")).cast("long")
            walked = walked.withColumn("_node", F.when(F.col("_end").isNull(), child).otherwise(F.col("_node"))).drop("_idx")
        ends = self.nodes.where("idx IS NULL").select(F.col("node").alias("_end"), "prediction")
        return walked.join(F.broadcast(ends), "_end").select(*points.columns, "prediction")


class Split(NamedTuple):
    """The word a node asks for and its rank by weight, ``RANKED`` if it is beyond the ranked ones."""

    idx: int
    rank: int


@dataclass(frozen=True)
class _Texts:
    """``rows``: ``own, weight, ranks, idxs``, the words of a text as packed numbers; weights of the ranked words, largest first."""

    rows: DataFrame
    idx_type: T.DataType
    top: np.ndarray
    weights: np.ndarray
    n_words: int
    rows_weight: float

    @classmethod
    def of(cls, points: DataFrame, labels: Sequence[Any]) -> _Texts:
        """The labelled ones of ``label, weight, idxs``, written once."""
        place = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("label")).cast("int") - 1
        known = points.where(F.col("label").isNotNull()).select(
            place.alias("own"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), "idxs"
        )
        idx_type = points.schema["idxs"].dataType.elementType
        number = np.dtype(np.int32 if isinstance(idx_type, T.IntegerType) else np.int64)
        known = known.withColumn("idxs", F.col("idxs").cast("array<int>" if number == np.int32 else "array<long>"))
        counts = stored(known.select("weight", F.explode("idxs").alias("idx")).groupBy("idx").agg(F.sum("weight").alias("w")), "tree-words")
        first = counts.orderBy(F.desc("w"), "idx").limit(RANKED).toPandas()
        top, weights = first["idx"].to_numpy(number), first["w"].to_numpy(float)
        order = np.argsort(top)
        ordered = top[order]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("idxs")
                idxs = lists.flatten().to_numpy(zero_copy_only=False).astype(number)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ranks = np.full(len(idxs), RANKED, np.int32)
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, idxs), len(ordered) - 1)
                    is_top = ordered[at] == idxs
                    ranks[is_top] = order[at[is_top]]
                packed = [_packed(ranks, sizes), _packed(idxs, sizes)]
                yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("weight"), *packed], ["own", "weight", "ranks", "idxs"])

        rows = stored(known.mapInArrow(pack, "own int, weight double, ranks binary, idxs binary"), "tree-texts")
        whole = rows.agg(F.sum("weight")).first()[0]
        return cls(rows, T.IntegerType() if number == np.int32 else T.LongType(), top, weights, counts.count(), whole)

    def limit(self, most: Callable[[float], float], gain: float) -> int:
        """So many words by rank hold the best: those beyond can gain ``most`` (of their weight), which is less than ``gain``."""
        limit = COMMON
        while limit < min(self.n_words, len(self.weights)):
            if _surely_less(most(self.weights[limit]), gain):
                return limit
            limit *= 2
        if self.n_words <= limit or (len(self.weights) == RANKED and _surely_less(most(self.weights[-1]), gain)):
            return min(limit, RANKED)
        return RANKED + 1


def _surely_less(most: float, gain: float) -> bool:
    return most * (1 + 1e-9) + 1e-8 < gain


def _packed(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64) * numbers.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(numbers)]).cast(pa.binary())


def _unpacked(column: pa.Array, number: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and how many there are in each row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, number), np.zeros(len(column), np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(number), np.diff(ends) // number.itemsize


@dataclass(frozen=True)
class _Chunk:
    """Some texts of a partition; ``row`` is the text of each word."""

    own: np.ndarray
    weight: np.ndarray
    ranks: np.ndarray
    idxs: np.ndarray
    row: np.ndarray

    @classmethod
    def all_of(cls, batches: Iterator[pa.RecordBatch], number: np.dtype, n_asked: int) -> Iterator[_Chunk]:
        held: list[pa.RecordBatch] = []

        def joined() -> _Chunk:
            ranks, idxs = ([_unpacked(b.column(name), kind) for b in held] for name, kind in (("ranks", np.dtype(np.int32)), ("idxs", number)))
            sizes = np.concatenate([size for _, size in ranks])
            own, weight = (np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in held]) for name in ("own", "weight"))
            words = (np.concatenate([each for each, _ in column]) for column in (ranks, idxs))
            return cls(own.astype(np.int64), weight, *words, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))

        n_rows = n_bytes = 0
        for batch in batches:
            held.append(batch)
            n_rows, n_bytes = n_rows + batch.num_rows, n_bytes + batch.nbytes
            if n_rows * max(n_asked, 64) > CHUNK_CELLS or n_bytes > CHUNK_WORDS * (4 + number.itemsize):
                yield joined()
                held, n_rows, n_bytes = [], 0, 0
        if n_rows:
            yield joined()

    def has(self, asked: Sequence[Split]) -> np.ndarray:
        """Whether each text has each word."""
        held = np.zeros((len(self.own), len(asked)), dtype=bool)
        if not asked:
            return held
        column = np.full(RANKED + 1, -1, np.int32)
        column[[s.rank for s in asked if s.rank < RANKED]] = [i for i, s in enumerate(asked) if s.rank < RANKED]
        found = column[self.ranks]
        at = np.flatnonzero(found >= 0)
        held[self.row[at], found[at]] = True
        rare = sorted((s.idx, i) for i, s in enumerate(asked) if s.rank == RANKED)
        if rare:
            idxs, columns = np.array(rare).T
            at = np.flatnonzero(self.ranks == RANKED)
            place = np.minimum(np.searchsorted(idxs, self.idxs[at]), len(idxs) - 1)
            same = idxs[place] == self.idxs[at]
            held[self.row[at[same]], columns[place[same]]] = True
        return held

    def words(self, least: int, most: int, common: np.ndarray) -> _Words:
        """The words of rank ``least`` and more and below ``most``, numbered once for all that is summed over them."""
        at = np.flatnonzero((self.ranks < most) & (self.ranks >= least))
        rank = self.ranks[at]
        number = rank.astype(np.int64)
        rare = np.flatnonzero(rank >= len(common))
        idxs, codes = _codes(self.idxs[at[rare]])
        number[rare] = codes + len(common)
        ranks = np.r_[np.arange(len(common), dtype=np.int32), np.zeros(len(idxs), np.int32)]
        ranks[number[rare]] = rank[rare]
        return _Words(self.row[at], rank, number, np.r_[common, idxs], ranks)


class _Words(NamedTuple):
    """Text, rank and number of each word of some texts; idx and rank by number."""

    row: np.ndarray
    rank: np.ndarray
    number: np.ndarray
    idxs: np.ndarray
    ranks: np.ndarray

    def below(self, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and number of the words whose rank is below the limit of their text."""
        held = np.flatnonzero(self.rank < limit[self.row])
        return self.row[held], self.number[held]


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in their order, and the place of each value among them."""
    if len(values) and values.min() >= 0 and values.max() < max(DENSE_SUMS, 2 * len(values)):
        place = np.zeros(int(values.max()) + 1, np.int64)
        place[values] = 1
        different = np.flatnonzero(place)
        place[different] = np.arange(len(different))
        return different.astype(values.dtype), place[values]
    return np.unique(values, return_inverse=True)


def _sums(key: np.ndarray, size: int, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys, below ``size``, that occur and the sums of each of ``values`` over them."""
    if size <= max(DENSE_SUMS, 2 * len(key)):
        present = np.zeros(size, dtype=bool)
        present[key] = True
        keys = np.flatnonzero(present)
        return keys, [np.bincount(key, v, size)[keys] for v in values]
    keys, inverse = np.unique(key, return_inverse=True)
    return keys, [np.bincount(inverse, v, len(keys)) for v in values]


class _Walk:
    """The way of texts down trees; ``asked`` are the distinct words of all of them."""

    def __init__(self, trees: Sequence[Mapping[int, Split]]):
        self.asked = sorted({split for tree in trees for split in tree.values()})
        column = {split: i for i, split in enumerate(self.asked)}
        self._nodes = [sorted(tree) for tree in trees]
        self._columns = [[column[tree[node]] for node in nodes] for tree, nodes in zip(trees, self._nodes, strict=True)]

    def ends(self, tree: int, has: np.ndarray) -> np.ndarray:
        """The node of each text."""
        node = np.full(len(has), ROOT, dtype=np.int64)
        nodes, columns = np.array(self._nodes[tree], np.int64), np.array(self._columns[tree], np.int64)
        if not len(nodes):
            return node
        live = np.arange(len(has))
        for _ in range(int(nodes[-1]).bit_length()):
            at = np.minimum(np.searchsorted(nodes, node[live]), len(nodes) - 1)
            inner = nodes[at] == node[live]
            live, at = live[inner], at[inner]
            node[live] = 2 * node[live] + has[live, columns[at]]
        return node


def _table(columns: Mapping[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _number(texts: _Texts) -> np.dtype:
    return np.dtype(np.int32 if isinstance(texts.idx_type, T.IntegerType) else np.int64)


class Best(NamedTuple):
    """The word of a node with the largest gain, and the sums of the texts that have it."""

    idx: int
    rank: int
    gain: float
    sums: list[float]

    def beats(self, other: Best | None) -> bool:
        return other is None or (self.gain, -self.idx) > (other.gain, -other.idx)


#: Sums inside and in all, a column for each value -> the weight outside and the gain.
Gain = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _merged(place: np.ndarray, idx: np.ndarray, rank: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One row for each place and word."""
    words, code = _codes(idx)
    ranks = np.zeros(len(words), rank.dtype)
    ranks[code] = rank
    keys, added = _sums(place.astype(np.int64) * len(words) + code, (int(place.max(initial=-1)) + 1) * len(words), *sums.T)
    word = keys % max(len(words), 1)
    return keys // max(len(words), 1), words[word], ranks[word], np.stack(added, axis=1)


def _best(texts: _Texts, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], totals: np.ndarray, gain: Gain) -> dict[int, Best]:
    """The best word of each place that gains by one, the first of equal ones.

    ``run`` makes ``place, idx, rank, v0, v1, ...`` of the texts of a partition; the sums meet by
    word, many packed into a row, and the best of each task come to the driver.
    """
    values = [f"v{i}" for i in range(totals.shape[1])]
    kinds = {"place": np.dtype(np.int32), "idx": _number(texts), "rank": np.dtype(np.int32)} | dict.fromkeys(values, np.dtype(np.float64))
    n_pieces = int(texts.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in run(batches):
            piece = table.column("idx").to_numpy(zero_copy_only=False) % n_pieces
            order, sizes = np.argsort(piece, kind="stable"), np.bincount(piece, minlength=n_pieces)
            pieces = np.flatnonzero(sizes)
            columns = (table.column(name).to_numpy(zero_copy_only=False).astype(kind)[order] for name, kind in kinds.items())
            packed = [_packed(column, sizes[pieces]) for column in columns]
            yield pa.RecordBatch.from_arrays([pa.array(pieces.astype(np.int32)), *packed], ["piece", *kinds])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = n_merged = 0
        for batch in batches:
            place, idx, rank, *sums = (_unpacked(batch.column(name), kind)[0] for name, kind in kinds.items())
            held.append((place, idx, rank, np.stack(sums, axis=1)))
            n_held += len(place)
            if n_held > HELD_SUMS + 2 * n_merged:
                held = [_merged(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                n_held = n_merged = len(held[0][0])
        if not held:
            return
        place, idx, rank, sums = _merged(*(np.concatenate(c) for c in zip(*held, strict=True)))
        outside, gains = gain(sums, totals[place])
        gains = np.round(gains, DIGITS)
        helps = np.flatnonzero((outside > 0) & (gains > 0))
        order = helps[np.lexsort((idx[helps], -gains[helps], place[helps]))]
        first = order[np.flatnonzero(np.r_[True, place[order[1:]] != place[order[:-1]]])] if len(order) else order
        found = {"place": place[first].astype(np.int32), "idx": idx[first], "rank": rank[first], "gain": gains[first]}
        yield _table(found | dict(zip(values, sums[first].T, strict=True)))

    dealt = texts.rows.mapInArrow(deal, "piece int, " + ", ".join(f"{name} binary" for name in kinds)).repartition("piece")
    kind = f"idx {texts.idx_type.simpleString()}, rank int"
    doubles = ", ".join(f"{v} double" for v in values)
    best: dict[int, Best] = {}
    for row in dealt.mapInArrow(choose, f"place int, {kind}, gain double, {doubles}").collect():
        one = Best(row["idx"], row["rank"], row["gain"], [row[v] for v in values])
        if one.beats(best.get(row["place"])):
            best[row["place"]] = one
    return best


def _search(
    texts: _Texts, totals: Mapping[Any, Sequence[float]], weight: Callable[[Any], float], most: Callable[[Any, float], float],
    find: Callable[[list[Any], np.ndarray, int], dict[int, Best]],
) -> dict[Any, Best]:
    """The best word of each node: of the common words first, small nodes of all words; then of others that could still win.

    ``most`` is the most that a word of some weight can gain at a node; ``find`` gives the best words from a
    rank on and below the limit of each node, by its place.
    """
    nodes = sorted(totals)
    if not nodes:
        return {}
    whole = float(texts.rows_weight)
    limits = [COMMON if weight(node) > whole * SMALL else RANKED + 1 for node in nodes]
    best = {nodes[place]: one for place, one in find(nodes, np.array(limits), 0).items()}
    further = [
        texts.limit(lambda w, node=node: most(node, w), best[node].gain if node in best else 0.0) if limit == COMMON else 0
        for node, limit in zip(nodes, limits, strict=True)
    ]
    open_ = [place for place, limit in enumerate(further) if limit > COMMON]
    if open_:
        left = [nodes[place] for place in open_]
        for place, one in find(left, np.array([further[place] for place in open_]), COMMON).items():
            if one.beats(best.get(left[place])):
                best[left[place]] = one
    return best


def _most_bits(weight: float, total: float) -> float:
    """What a word of at most ``weight`` texts of ``total`` can gain in entropy: that of having it."""
    share = min(weight / total, 0.5)
    return -share * math.log(share) - (1 - share) * math.log1p(-share) if share > 0 else 0.0


def _chaos(counts: np.ndarray) -> np.ndarray:
    """Entropy of class weights, times their sum."""

    def n_log_n(value: np.ndarray) -> np.ndarray:
        return value * np.log(value, out=np.zeros_like(value), where=value > 0)

    return n_log_n(counts.sum(axis=1)) - n_log_n(np.maximum(counts, 0)).sum(axis=1)


def _entropy_gain(inside: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    outside = whole - inside
    return outside.sum(axis=1), (_chaos(whole) - _chaos(inside) - _chaos(outside)) / whole.sum(axis=1)


def _best_splits(texts: _Texts, splits: Mapping[int, Split], totals: Mapping[int, Sequence[float]]) -> dict[int, Best]:
    """The best words of the nodes ``totals``."""
    n = len(next(iter(totals.values()), []))
    walk, number, common = _Walk([splits]), _number(texts), texts.top[:COMMON]

    def find(nodes: list[int], limits: np.ndarray, least: int) -> dict[int, Best]:
        ids = np.array(nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _Chunk.all_of(batches, number, len(walk.asked)):
                node = walk.ends(0, chunk.has(walk.asked))
                place = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                words = chunk.words(least, limits.max(), common)
                row, word = words.below(np.where(ids[place] == node, limits[place], 0))
                idxs = words.idxs
                key, (weight,) = _sums((place[row] * len(idxs) + word) * n + chunk.own[row], len(ids) * len(idxs) * n, chunk.weight[row])
                both, inverse = np.unique(key // n, return_inverse=True)
                if len(both):
                    sums = np.bincount(inverse * n + key % n, weight, len(both) * n).reshape(-1, n)
                    word = both % len(idxs)
                    found = {"place": (both // len(idxs)).astype(np.int32), "idx": idxs[word], "rank": words.ranks[word]}
                    yield _table(found | {f"v{i}": sums[:, i] for i in range(n)})

        return _best(texts, run, np.array([totals[node] for node in nodes], float), _entropy_gain)

    return _search(texts, totals, lambda node: sum(totals[node]), lambda node, w: _most_bits(w, sum(totals[node])), find)


def fit_tree(points: DataFrame, max_depth: int = TREE_DEPTH) -> DecisionTree:
    """Grow a tree level by level by the gain in entropy on ``label, weight, idxs``.

    The texts are written once, with their words as packed numbers; a level sends each down
    the tree so far and sums the words at the open nodes. A node has at most ``max_depth``
    ancestors, so a level has at most ``2 ** max_depth`` nodes, and they are joined by
    broadcast. The prediction of a leaf is its heaviest class, the smallest label of equal ones.
    """
    labels = list(class_counts(points))
    texts = _Texts.of(points, labels)
    counts = {row["own"]: row["w"] for row in texts.rows.groupBy("own").agg(F.sum("weight").alias("w")).collect()}
    totals: dict[int, list[float]] = {ROOT: [counts.get(i, 0.0) for i in range(len(labels))]}
    splits: dict[int, Split] = {}
    rows, level = [], 0
    while totals:
        mixed = {node: t for node, t in totals.items() if sum(c > 0 for c in t) > 1}
        best = _best_splits(texts, splits, mixed) if level < max_depth and texts.n_words else {}
        following = {}
        for node, t in sorted(totals.items()):
            idx = None
            if node in best:
                idx, inside = best[node].idx, best[node].sums
                splits[node] = Split(idx, best[node].rank)
                following[2 * node], following[2 * node + 1] = [a - b for a, b in zip(t, inside, strict=True)], inside
            rows.append((node, level, idx, labels[t.index(max(t))], t))
        totals, level = following, level + 1
    schema = T.StructType([
        T.StructField("node", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("idx", texts.idx_type),
        T.StructField("prediction", points.schema["label"].dataType),
        T.StructField("counts", T.ArrayType(T.DoubleType())),
    ])
    return DecisionTree(labels, points.sparkSession.createDataFrame(rows, schema), level - 1)


def _softmax(raw: Column) -> Column:
    weights = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v))


class ClassTree(NamedTuple):
    """A tree for one class: the word each inner node asks for and the value of each leaf, less than ``2 ** (depth + 1)`` in all."""

    splits: dict[int, int]
    values: dict[int, float]


@dataclass(frozen=True)
class BoostedTrees:
    """One ensemble for all classes: ``rounds[r][k]`` is the tree of round ``r`` for class ``k``; the children of node ``n`` are ``2n`` and ``2n + 1``."""

    labels: list[Any]
    rounds: list[list[ClassTree]]
    losses: list[float]
    name: str = "boosted"

    def raw(self, points: DataFrame) -> DataFrame:
        """Add ``raw``, for each class the sum of the leaf values of all rounds. No shuffle."""
        values = [_summed([F.lit(0.0), *(_value(trees[k]) for trees in self.rounds)]) for k in range(len(self.labels))]
        return points.withColumn("raw", F.array(*values))

    def predict(self, points: DataFrame) -> DataFrame:
        """Add ``prediction`` (the smallest label of equal ones) and ``probability`` in label order."""
        labels = F.array(*[F.lit(label) for label in self.labels])
        rounded = F.transform("raw", lambda v: F.round(v, DIGITS))
        best = F.array_position(rounded, F.array_max(rounded)).cast("int") - 1
        scored = self.raw(points)
        return scored.select(*points.columns, F.get(labels, best).alias("prediction"), _softmax(F.col("raw")).alias("probability"))

    def save(self, path: str) -> None:
        trees = [[[sorted(t.splits.items()), sorted(t.values.items())] for t in trees] for trees in self.rounds]
        facts = json.dumps({"labels": self.labels, "rounds": trees, "losses": self.losses}, ensure_ascii=False)
        SparkSession.getActiveSession().createDataFrame([(facts,)], "facts string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        facts = json.loads(SparkSession.getActiveSession().read.text(path).first()["value"])
        rounds = [[ClassTree(dict(splits), dict(values)) for splits, values in trees] for trees in facts["rounds"]]
        return cls(facts["labels"], rounds, facts["losses"])


def _map_of(values: dict[int, Any]) -> Column:
    return F.create_map(*[F.lit(x) for item in sorted(values.items()) for x in item])


def _leaf(splits: dict[int, int]) -> Column:
    """The node at which a row ends that starts at the root."""
    if not splits:
        return F.lit(ROOT)
    asked = _map_of(splits)

    def down(node: Column, _: Column) -> Column:
        word = F.try_element_at(asked, node)
        return F.when(word.isNull(), node).otherwise(2 * node + F.array_contains("idxs", word).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(splits).bit_length())), F.lit(ROOT), down)


def _value(tree: ClassTree) -> Column:
    return F.coalesce(F.try_element_at(_map_of(tree.values), _leaf(tree.splits)), F.lit(0.0))


def fit_boosted(
    points: DataFrame, rounds: int = BOOST_ROUNDS, rate: float = BOOST_RATE, depth: int = BOOST_DEPTH
) -> BoostedTrees:
    """Boost on the gradients of the multi-class log loss, a tree for each class in a round.

    A round computes what each class lacks, the label minus its probability among all
    classes, so the trees of a round depend on each other through the rounds before. A
    node asks for the word that makes the squared sums of what is lacking, each over its
    weight plus ``LEAF_PULL``, largest on both sides; the first of equal ones. A leaf adds
    ``rate`` times the mean of what it lacks, pulled to zero. One aggregate a level, over
    (class, node, word), serves all trees of a round. The texts are written once; their raw scores
    follow from the trees so far in every pass. The driver sees splits and leaves only. ``losses`` has
    the mean loss before each round and after the last.
    """
    labels = list(class_counts(points))
    texts = _Texts.of(points, labels)
    state = _Boosting(len(labels), [], [])
    all_trees: list[list[ClassTree]] = []
    losses: list[float] = []
    while True:
        roots = _roots(texts, state)
        losses.append(roots["loss"] / roots["weight"])
        if len(all_trees) == rounds:
            return BoostedTrees(labels, all_trees, losses)
        splits: list[dict[int, Split]] = [{} for _ in labels]
        # Sums of what is lacking and of the weight at the leaves so far.
        leaves = [{ROOT: (g, roots["weight"])} for g in roots["g"]]
        for level in range(depth if texts.n_words else 0):
            best = _best_words(texts, state, splits, ROOT << level, leaves, roots["most"])
            for (k, node), found in best.items():
                splits[k][node] = Split(found.idx, found.rank)
                g, weight = leaves[k].pop(node)
                g_in, weight_in = found.sums
                leaves[k][2 * node], leaves[k][2 * node + 1] = (g - g_in, weight - weight_in), (g_in, weight_in)
            if not best:
                break
        trees = [
            ClassTree({node: s.idx for node, s in tree.items()}, {node: rate * g / (w + LEAF_PULL) for node, (g, w) in ends.items()})
            for tree, ends in zip(splits, leaves, strict=True)
        ]
        all_trees.append(trees)
        state = _Boosting(state.n, [*state.splits, *splits], [*state.values, *(tree.values for tree in trees)])


class _Boosting(NamedTuple):
    """The trees of the rounds so far, class by class in each round."""

    n: int
    splits: list[dict[int, Split]]
    values: list[dict[int, float]]

    def lacking(self, chunk: _Chunk, walk: _Walk, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each class lacks in each text, and the loss of each text."""
        raw = np.zeros((len(chunk.own), self.n))
        for t, values in enumerate(self.values):
            ends = np.array(sorted(values), np.int64)
            raw[:, t % self.n] += np.array([values[end] for end in ends.tolist()])[np.searchsorted(ends, walk.ends(t, has))]
        chance = np.exp(raw - raw.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        each = np.arange(len(chunk.own))
        loss = -chunk.weight * np.log(chance[each, chunk.own])
        lack = -chance
        lack[each, chunk.own] += 1
        return lack * chunk.weight[:, None], loss


def _roots(texts: _Texts, state: _Boosting) -> dict[str, Any]:
    """Sums over all texts: of what each class lacks, of weights and losses; ``most`` is the most a text lacks of its weight, by class."""
    walk, number = _Walk(state.splits), _number(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _Chunk.all_of(batches, number, len(walk.asked)):
            lack, loss = state.lacking(chunk, walk, chunk.has(walk.asked))
            most = np.divide(np.abs(lack), chunk.weight[:, None], out=np.zeros_like(lack), where=chunk.weight[:, None] > 0).max(axis=0)
            totals = {"weight": np.full(state.n, chunk.weight.sum()), "loss": np.full(state.n, loss.sum())}
            yield _table({"k": np.arange(state.n, dtype=np.int32), "g": lack.sum(axis=0), "most": most} | totals)

    sums = [F.sum(c).alias(c) for c in ("g", "weight", "loss")]
    found = texts.rows.mapInArrow(run, "k int, g double, most double, weight double, loss double").groupBy("k").agg(*sums, F.max("most").alias("most"))
    rows = sorted(found.collect(), key=lambda row: row["k"])
    return {"g": [r["g"] for r in rows], "most": [r["most"] for r in rows], "weight": rows[0]["weight"], "loss": rows[0]["loss"]}


def _score(g: Any, weight: Any) -> Any:
    return g * g / (weight + LEAF_PULL)


def _most_gain(weight: float, all_g: float, all_weight: float, most: float) -> float:
    """What a word of at most ``weight`` can gain: the gain is convex in weight and sum, so it is largest at a corner."""
    w = min(weight, all_weight)
    corners = [_score(g, w) + _score(all_g - g, all_weight - w) for g in (w * most, -w * most)]
    return max(0.0, max(corners) - _score(all_g, all_weight))


def _score_gain(inside: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    outside = whole - inside
    score = [_score(each[:, 0], each[:, 1]) for each in (inside, outside, whole)]
    return outside[:, 1], score[0] + score[1] - score[2]


def _best_words(
    texts: _Texts, state: _Boosting, splits: Sequence[Mapping[int, Split]], least_node: int,
    leaves: Sequence[Mapping[int, tuple[float, float]]], most: Sequence[float],
) -> dict[tuple[int, int], Best]:
    """The best words by class and node of the nodes from ``least_node`` on; their sums are those of what is lacking and of the weight."""
    totals = {(k, node): sums for k, ends in enumerate(leaves) for node, sums in ends.items() if node >= least_node}
    walk, number, common = _Walk([*state.splits, *splits]), _number(texts), texts.top[:COMMON]

    def find(nodes: list[tuple[int, int]], limits: np.ndarray, least: int) -> dict[int, Best]:
        classes = sorted({k for k, _ in nodes})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below, places = np.zeros((state.n, 2 * least_node), np.int64), np.zeros((state.n, 2 * least_node), np.int32)
            for place, (k, node) in enumerate(nodes):
                below[k, node], places[k, node] = limits[place], place
            for chunk in _Chunk.all_of(batches, number, len(walk.asked)):
                has = chunk.has(walk.asked)
                lack, _ = state.lacking(chunk, walk, has)
                words = chunk.words(least, below.max(), common)
                idxs = words.idxs
                for k in classes:
                    node = walk.ends(len(state.splits) + k, has)
                    row, word = words.below(below[k, node])
                    key, sums = _sums((node[row] - least_node) * len(idxs) + word, least_node * len(idxs), lack[row, k], chunk.weight[row])
                    if len(key):
                        word = key % len(idxs)
                        found = {"place": places[k, key // len(idxs) + least_node], "idx": idxs[word], "rank": words.ranks[word]}
                        yield _table(found | {f"v{i}": column for i, column in enumerate(sums)})

        return _best(texts, run, np.array([totals[node] for node in nodes], float), _score_gain)

    return _search(
        texts, totals, lambda node: totals[node][1], lambda node, w: _most_gain(w, *totals[node], most[node[0]]), find
    )
