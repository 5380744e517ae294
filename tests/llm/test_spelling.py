"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphask.llm import spelling_variants as sv

SMALL = str.maketrans(sv._CAPITALS, sv._SMALL)


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _counts(texts):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def _brute(texts):
    counts = _counts(texts)
    near = {w: [x for x in counts if _one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def _varied(rng, words, n):
    letters = "abcdeéñxyz"
    out = []
    for word in rng.choices(words, k=n):
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind != 2) :]
        out.append(word)
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aéxyzÿ"])
def test_pairs_are_all_pairs_one_edit_apart(spark, alphabet):
    rng = random.Random(alphabet)
    stems = ["".join(rng.choices(alphabet, k=rng.randint(7, 11))) for _ in range(60)]
    words = sorted({w for w in _varied(rng, stems, 900) if len(w) >= 7})
    table = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
    got = [(r["a"], r["b"]) for r in sv.near_pairs(table).collect()]
    want = {(a, b) for a, b in itertools.combinations(words, 2) if _one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_pivots_are_the_rarest_pair_that_does_not_overlap():
    rng = random.Random(1)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randint(3, 6)))
        costs = [rng.randint(1, 9) for _ in places]
        chosen = sv.pivots(places, costs)
        cost = dict(zip(places, costs, strict=True))
        options = [(cost[a] + cost[b], (a, b)) for a, b in itertools.combinations(places, 2) if b - a >= sv.GRAM]
        assert (sum(cost[p] for p in chosen), tuple(chosen)) == min(options)


def test_result_equals_all_pairs(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcdeéstrn", k=rng.randint(7, 12))) for _ in range(40)]
    texts = []
    for doc_id in range(300):
        words = [rng.choice(stems) for _ in range(30)] + _varied(rng, stems, 12) + ["short", "ÉCOLIERS", "écoliers", "Écoliers7x"]
        texts.append((doc_id, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    texts += [(None, "dictionary dictionary dictionary"), (400, None), (401, ""), (401, "?!"), (5, texts[5][1])]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, word string, n int")
    got = {tuple(r) for r in sv.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == _brute(texts) and any(r[1] for r in got)


def test_chains_end_at_the_most_frequent_form(spark):
    chain = ["letters", "lettersa", "lettersab", "lettersabc", "lettersabcd", "lettersabcde", "apart"]
    forms = spark.createDataFrame([*itertools.pairwise(chain[:-1])], "word string, form string")
    assert {r["word"]: r["root"] for r in sv.roots(forms).collect()} == dict.fromkeys(chain[:-2], chain[-2])


def test_words_of_given_sizes_only(spark):
    text = " ".join(["sixsix", "sevenes", "sevenes", "once" * 3] + ["x" * 50_000] * 2)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sv.count_words(docs).collect()
    assert {r["word"]: r["n"] for r in got} == _counts([(1, text)])
    assert sv.spelling_variants(docs.where(F.lit(False))).count() == 0
    assert sv.spelling_variants(docs.withColumn("text", F.lit("no long words"))).count() == 0


def test_order_of_bigrams_is_by_frequency(spark):
    words = spark.createDataFrame([("aaaaaab", 5), ("abababa", 2)], "word string, n long")
    order = sv.gram_order(words)
    assert order == {"ba": (0, 3), "ab": (1, 4), "aa": (2, 5)}
    # All occurrences of the third bigram belong to the prefix.
    assert sv.prefix("abababa", order) == [(0, 1), (0, 3), (0, 5)] and len(sv.prefix("aaaaaab", order)) == 6
