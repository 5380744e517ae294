"""Trees and boosting on long tables against small numpy versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphask.operators import trees as tr

SCHEMA = "id long, label string, weight double, idxs array<int>"


def _rows(seed, n=120, n_words=14, labels=("a", "b", "c")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice(labels)
        likely = {w for w in range(n_words) if (w + labels.index(label)) % 3 == 0}
        words = [w for w in range(n_words) if rng.random() < (0.6 if w in likely else 0.2)]
        rows.append((i, label, float(rng.choice([1, 1, 2])), words))
    return rows


def _matrix(rows, n_words=14):
    x = np.zeros((len(rows), n_words), dtype=bool)
    for i, row in enumerate(rows):
        x[i, row[3]] = True
    labels = sorted({r[1] for r in rows})
    return x, np.array([labels.index(r[1]) for r in rows]), np.array([r[2] for r in rows]), labels


def _entropy_sum(w):
    total = w.sum()
    return sum(-c * math.log(c / total) for c in w if c > 0)


def _numpy_tree(x, y, weight, n_classes, depth, node=1, rows=None, at=0):
    rows = np.arange(len(y)) if rows is None else rows
    counts = np.bincount(y[rows], weight[rows], n_classes)
    best = (0, None)
    if at < depth:
        for word in range(x.shape[1]):
            inside = x[rows, word]
            if inside.all() or not inside.any():
                continue
            sides = [np.bincount(y[rows[s]], weight[rows[s]], n_classes) for s in (inside, ~inside)]
            gain = round((_entropy_sum(counts) - sum(map(_entropy_sum, sides))) / counts.sum(), 9)
            if gain > best[0]:
                best = (gain, word)
    nodes = {node: (at, best[1], int(counts.argmax()), counts.tolist())}
    if best[1] is not None:
        inside = x[rows, best[1]]
        nodes |= _numpy_tree(x, y, weight, n_classes, depth, 2 * node, rows[~inside], at + 1)
        nodes |= _numpy_tree(x, y, weight, n_classes, depth, 2 * node + 1, rows[inside], at + 1)
    return nodes


@pytest.mark.parametrize("depth", [3, 16])
def test_tree_equals_numpy(spark, depth):
    rows = _rows(depth, n=60)
    tree = tr.fit_tree(spark.createDataFrame(rows, SCHEMA), depth)
    x, y, weight, labels = _matrix(rows)
    want = _numpy_tree(x, y, weight, len(labels), depth)
    got = {r["node"]: (r["depth"], r["idx"], labels.index(r["prediction"]), r["counts"]) for r in tree.nodes.collect()}
    assert got == want
    asked = spark.createDataFrame(rows + [(900, None, 1.0, []), (901, None, 1.0, [999])], SCHEMA)
    for r in tree.predict(asked).collect():
        node = 1
        while want[node][1] is not None:
            node = 2 * node + (want[node][1] in r["idxs"])
        assert r["prediction"] == labels[want[node][2]]


def _numpy_class_tree(x, g, weight, depth):
    """Splits and the node of every row."""
    node, splits = np.ones(len(g), dtype=int), {}
    for level in range(depth):
        for one in [n for n in np.unique(node) if n >= 1 << level]:
            here, scores = node == one, []
            for word in range(x.shape[1]):
                inside, outside = here & x[:, word], here & ~x[:, word]
                if inside.any() and outside.any():
                    parts = ((inside, 1), (outside, 1), (here, -1))
                    score = sum(s * float(g[p].sum() ** 2 / (weight[p].sum() + tr.LEAF_PULL)) for p, s in parts)
                    scores.append((-round(score, 9), word))
            if scores and min(scores)[0] < 0:
                splits[int(one)] = min(scores)[1]
        node = np.array([2 * n + x[i, splits[n]] if n in splits and n >= 1 << level else n for i, n in enumerate(node)])
    return splits, node


def _numpy_boosted(x, y, weight, n_classes, rounds, rate, depth):
    raw = np.zeros((len(y), n_classes))
    truth = np.eye(n_classes)[y]
    all_splits, losses = [], []
    for r in range(rounds + 1):
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        losses.append(float((-np.log(p[np.arange(len(y)), y]) * weight).sum() / weight.sum()))
        if r == rounds:
            return all_splits, raw, losses
        g = weight[:, None] * (truth - p)
        all_splits.append([])
        for k in range(n_classes):
            splits, node = _numpy_class_tree(x, g[:, k], weight, depth)
            for one in np.unique(node):
                here = node == one
                raw[here, k] += rate * g[here, k].sum() / (weight[here].sum() + tr.LEAF_PULL)
            all_splits[-1].append(splits)


def test_boosting_equals_numpy_and_its_loss_falls(spark, tmp_path):
    rows = _rows(7)
    points = spark.createDataFrame(rows, SCHEMA)
    model = tr.fit_boosted(points, rounds=3, rate=0.5, depth=3)
    x, y, weight, labels = _matrix(rows)
    splits, raw, losses = _numpy_boosted(x, y, weight, len(labels), 3, 0.5, 3)
    assert [[tree.splits for tree in trees] for trees in model.rounds] == splits and model.labels == labels
    assert model.losses == pytest.approx(losses) and all(a > b for a, b in zip(losses, losses[1:], strict=False))
    assert losses[0] == pytest.approx(math.log(3))
    got = {r["id"]: r for r in model.raw(points).collect()}
    for i in range(len(rows)):
        assert got[i]["raw"] == pytest.approx(raw[i].tolist())
    model.save(str(tmp_path / "m"))
    assert tr.BoostedTrees.load(str(tmp_path / "m")) == model


def test_points_hold_every_word_once(spark):
    hits = spark.createDataFrame([(1, 9), (1, 2), (1, 9), (3, 5), (4, 1)], "id long, idx int")
    labelled = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, label string")
    got = {r["id"]: (r["label"], r["idxs"]) for r in tr.sparse_points(hits, labelled, "id").collect()}
    assert got == {1: ("a", [2, 9]), 2: ("b", []), 3: (None, [5])}


def test_trees_need_neither_words_nor_two_classes(spark):
    one = spark.createDataFrame([(1, "a", 1.0, [1]), (2, "a", 1.0, []), (3, None, 1.0, [1])], SCHEMA)
    tree = tr.fit_tree(one)
    assert [(r["node"], r["idx"], r["prediction"]) for r in tree.nodes.collect()] == [(1, None, "a")]
    wordless = spark.createDataFrame([(1, "a", 1.0, []), (2, "b", 2.0, [])], SCHEMA)
    model = tr.fit_boosted(wordless, rounds=1)
    assert [t.splits for t in model.rounds[0]] == [{}, {}] and model.predict(wordless).where(F.col("prediction") == "b").count() == 2
    with pytest.raises(ValueError, match="no training samples"):
        tr.fit_tree(one.limit(0))


def _rows_with_rare_words(n=160, n_words=6_000):
    """Common words that tell little and many rare ones, more than are summed at every node."""
    rng = random.Random(3)
    rows = [(i, label, weight, sorted(set(words) | set(rng.sample(range(14, n_words), 90)))) for i, label, weight, words in _rows(5, n=n)]
    return rows, n_words


def test_rare_words_win_where_they_gain_most(spark):
    rows, n_words = _rows_with_rare_words()
    points = spark.createDataFrame(rows, SCHEMA)
    x, y, weight, labels = _matrix(rows, n_words)
    assert (x.any(axis=0)).sum() > tr.COMMON
    tree = tr.fit_tree(points, 4)
    got = {r["node"]: (r["depth"], r["idx"], labels.index(r["prediction"]), r["counts"]) for r in tree.nodes.collect()}
    assert got == _numpy_tree(x, y, weight, len(labels), 4)
    model = tr.fit_boosted(points, rounds=1, depth=3)
    splits, _, losses = _numpy_boosted(x, y, weight, len(labels), 1, tr.BOOST_RATE, 3)
    assert [[t.splits for t in trees] for trees in model.rounds] == splits and model.losses == pytest.approx(losses)


def test_no_word_gains_more_than_its_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        lack, has = rng.uniform(-0.7, 0.7, 50), rng.random(50) < rng.random()
        inside, whole = np.array([[lack[has].sum(), has.sum()]]), np.array([[lack.sum(), 50.0]])
        bound = tr._most_gain(float(has.sum()) + rng.integers(3), whole[0, 0], 50.0, 0.7)
        assert tr._score_gain(inside, whole)[1][0] <= bound + 1e-9
        own = rng.integers(0, 3, 50)
        sides = [np.bincount(own[part], minlength=3).astype(float)[None] for part in (has, np.full(50, True))]
        assert tr._entropy_gain(*sides)[1][0] <= tr._most_bits(float(has.sum()), 50.0) + 1e-9


def test_rounds_write_no_tables(spark, monkeypatch):
    """The texts are written once, not again in every round and level."""
    written = []
    monkeypatch.setattr(tr, "stored", lambda df, name, stored=tr.stored: written.append(name) or stored(df, name))
    points = spark.createDataFrame(_rows(2, n=30), SCHEMA)
    tr.fit_boosted(points, rounds=3, depth=2)
    tr.fit_tree(points, 3)
    assert sorted(written) == ["tree-texts", "tree-texts", "tree-words", "tree-words"]


def test_sums_are_shuffled_in_few_rows(spark, monkeypatch):
    """Thousands of words, whose sums a task packs into a row for each piece of the shuffle."""
    rows, n_words = _rows_with_rare_words()
    points = spark.createDataFrame(rows, SCHEMA).repartition(2)
    shuffled, repartition = [], type(points).repartition
    monkeypatch.setattr(type(points), "repartition", lambda df, *by: shuffled.append(df.count()) or repartition(df, *by))
    tr.fit_boosted(points, rounds=1, depth=1)
    tr.fit_tree(points, 1)
    n_labels = len({row[1] for row in rows})
    assert n_words > 4000 and shuffled and max(shuffled) <= 4 * 4 * n_labels


@pytest.mark.parametrize("values", [[], [5], [3, 1, 3, 0], [-2, 7, -2], [1 << 40, 2, 1 << 40], list(range(50, 0, -1)) * 3])
def test_codes_are_places_among_the_different_values(values):
    values = np.array(values, np.int64)
    different, codes = tr._codes(values)
    assert different.tolist() == sorted(set(values.tolist())) and different[codes].tolist() == values.tolist()
