"""The best way through overlapping dictionary hits against all ways."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphask import schemas
from graphask.functions import text as tx
from graphask.operators.tagging import Lexicon, tag_entities

HITS = "id int, n int, hits array<struct<start: int, neg_len: int, len: int, word: string, tag: string, cost: double>>"


def _ways(n, hits):
    """All sets of hits that do not overlap."""
    for size in range(len(hits) + 1):
        for chosen in itertools.combinations(sorted(hits), size):
            if all(a[0] + a[1] <= b[0] for a, b in itertools.pairwise(chosen)):
                yield chosen


def _cost(n, chosen, other):
    return sum(c for *_, c in chosen) + other * (n - sum(k for _, k, _ in chosen))


def test_cheapest_way_equals_exhaustive_search(spark):
    rng = random.Random(1)
    rows, cases = [], []
    for i in range(120):
        n = rng.randint(1, 9)
        hits = {}
        for _ in range(rng.randint(0, 8)):
            start = rng.randrange(n)
            hits[start, rng.randint(1, n - start)] = round(rng.uniform(0.5, 9), 3)
        flat = [(s, k, c) for (s, k), c in hits.items()]
        cases.append((n, flat))
        rows.append((i, n, [(s, -k, k, f"{s}-{k}", None, c) for s, k, c in sorted(flat, key=lambda h: (h[0], -h[1]))]))
    df = spark.createDataFrame(rows, HITS)
    got = df.select("id", tx.cheapest_path(F.col("hits"), 5.0).alias("path")).collect()
    for r in got:
        n, flat = cases[r["id"]]
        path = tuple((h["start"], h["len"], dict(((s, k), c) for s, k, c in flat)[h["start"], h["len"]]) for h in r["path"])
        assert all(a[0] + a[1] <= b[0] for a, b in itertools.pairwise(path))
        best = min(_cost(n, chosen, 5.0) for chosen in _ways(n, flat))
        assert math.isclose(_cost(n, path, 5.0), best)


def _terms(spark, dictionary, text, **options):
    lexicon = Lexicon(spark.createDataFrame(dictionary, schemas.DICTIONARY), **options)
    questions = spark.createDataFrame([(1, text)], schemas.QUESTIONS)
    return [t["word"] for t in tag_entities(questions, lexicon).first()["terms"]]


@pytest.mark.parametrize(
    ("text", "longest", "lattice"),
    [
        ("研究生命起源", ["研究生", "命", "起源"], ["研究", "生命", "起源"]),
        ("研究生", ["研究生"], ["研究生"]),
        ("abc", ["abc"], ["abc"]),
        ("", [], []),
    ],
)
def test_frequencies_settle_overlaps(spark, text, longest, lattice):
    dictionary = [("研究生", "n", 20, 0), ("研究", "v", 500, 0), ("生命", "n", 800, 0), ("起源", "n", 300, 0), ("命", "n", 5, 0)]
    assert _terms(spark, dictionary, text) == longest
    assert _terms(spark, dictionary, text, by_frequency=True) == lattice


def test_long_texts_stay_whole(spark):
    dictionary = [("研究生", "n", 20, 0), ("研究", "v", 500, 0), ("生命", "n", 800, 0)]
    words = _terms(spark, dictionary, "研究生命" * 500, by_frequency=True)
    assert words == ["研究", "生命"] * 500
