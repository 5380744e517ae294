"""Operators that SQL does not express, against plain Python on small inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from graphask.llm.components import components
from graphask.llm.decontaminate import find_leaks
from graphask.llm.license_scan import closest, scan, templates
from graphask.llm.hashed_text import bare
from graphask.llm.masked_lm import CLASSES, OFFSETS, Network, Tokens, encode, fit_network, fit_vocabulary, score_documents
from graphask.llm.ordinal_quality import OrdinalModel
from graphask.llm.sharding import shards
from graphask.llm.simhash import fingerprint, links, near_duplicates
from graphask.llm.soft_mixing import fit_rates, mixing_rates
from graphask.llm.suffix_dedup import LENGTH, remove_repeats
from graphask.llm.textbytes import pieces
from graphask.llm.toxicity_fm import FactorizationMachine


def _components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_words_are_those_of_a_split():
    texts = ["a bc\td\n\x0bé  ü", "", None, " x", "y ", "\x1cz w"]
    got = defaultdict(list)
    for words in pieces(pa.array(texts), size=4):
        for s, e, d in zip(words.start, words.end, words.doc, strict=True):
            got[words.first + int(d)].append(words.data[s:e].tobytes())
    assert [got[i] for i in range(len(texts))] == [(t or "").encode().split() for t in texts]


@pytest.mark.parametrize("text", ["", "one", "Two Words", "a b c d e A B C", "é è " * 50, None])
def test_fingerprint(text):
    words = [w.lower() if w.isascii() else w for w in (text or "").split()]
    pieces_ = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxh64_intdigest(p.encode(), seed=42) for p in pieces_]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(text) == _signed(want)


def test_links_connect_exactly_what_is_within_three_bits(spark):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for n in (1, 2, 3, 3, 4, 5):
            flipped = base
            low = rng.choice([0, 16, 32, 48])
            for bit in rng.sample(range(low, low + 16) if rng.random() < 0.5 else range(64), n):
                flipped ^= 1 << bit
            values.add(flipped)
    values |= {bit_pair for bit_pair in (1 << i | 1 << (i + 1) for i in range(0, 62, 2))}
    values = sorted(values)
    near = [(_signed(a), _signed(b)) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    prints = spark.createDataFrame([(_signed(v),) for v in values], "fingerprint long")
    found = [(r["a"], r["b"]) for r in links(prints).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in found)
    assert _components(found) == _components(near)
    # Stars, not pairs: a crowded neighbourhood costs as much as its members, by a constant.
    assert len(found) <= 40 * len(values)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 300), (300, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in _components([e for e in edges if e[0] != e[1]]).items()}


def test_near_copies_share_a_component(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    other = [f"v{rng.randrange(500)}" for _ in range(400)]
    rows = [(5, " ".join(base)), (3, " ".join(base).upper()), (9, " ".join(near)), (7, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    linked = ((prints[5] ^ prints[9]) & ((1 << 64) - 1)).bit_count() <= 3
    assert got[3] == got[5] == 3 and got[7] == 7 and (got[9] == 3) == linked


def _removed(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: (1, 0) if i is None else (0, i)
    for i, t in texts:
        for p in range(len(t) - LENGTH + 1):
            s = t[p : p + LENGTH]
            first[s] = min(first.get(s, (2, 0)), rank(i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - LENGTH + 1):
            if first[t[p : p + LENGTH]] < rank(i):
                gone[p : p + LENGTH] = b"\1" * LENGTH
        out.append((i, len(t), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_removed_bytes(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh ", "aé \n"][seed]
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(30, 180))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5)]
        rows.append((rng.choice([i, i, i, 3, None]), "".join(parts)[: rng.randrange(1, 600)]))
    rows += [(50, "x" * 500), (51, "x" * 49), (52, "y" * 120 + "x" * 60), (53, "\0" * 70), (54, "\0" * 60)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), n_parts=3).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got], key=str) == _removed(rows)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])


ITEM = "A train leaves Boston at 9 and travels 120 km to reach Albany before noon. How fast does it go in all?"


@pytest.mark.parametrize(
    ("text", "held"),
    [
        ("Intro words here. " + ITEM + " The end.", True),
        ("A train leaves Dallas at 7 and travels 250 miles to reach Austin before noon. How fast does it go in all?", True),
        (ITEM.upper(), True),
        ("A train leaves Boston and reaches Albany. Nothing else is the same in this text at all, not even close.", False),
        (ITEM[:50], False),
    ],
)
def test_parameterised_items(spark, text, held):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert bool(find_leaks(docs, items).collect()) == held


def test_items_dense_in_slots_are_found_with_other_values(spark):
    item = "On Monday Tom paid 12 euros, Ann paid 15 euros, Max paid 18 euros and Eva paid 21 euros for the trip."
    other = "On Friday Bob paid 32 euros, Liz paid 35 euros, Jim paid 38 euros and Sue paid 41 euros for the trip."
    rows = [(1, f"Some words before. {other} And some after."), (2, "Tom paid 12 euros for the trip and Ann paid 15 euros on Monday.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["n_conflicts"]) for r in found] == [(1, 0)]


def test_slots_must_map_consistently(spark):
    item = "first add 5 apples then take 5 apples and give 5 apples away so that again 5 apples stay on the table"
    same = item.replace("5", "8")
    mixed = "first add 1 apples then take 2 apples and give 3 apples away so that again 4 apples stay on the table"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    found = find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["n_conflicts"]) for r in found] == [(1, 0)]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Code. Licensed under the Apache License, Version 2.0.\nMore text.", ["Apache-2.0"]),
        ("this work is licensed under the gnu general public license, version 3", ["GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0. Words. Released under the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("The driver's license expired, and the licensed plumber left.", []),
        ("", []),
        (None, []),
    ],
)
def test_license_notices(text, names):
    found = scan(text)
    assert [m.license for m in found] == names
    assert all(0 <= m.start < m.end <= len(text) and m.bytes_saved > 0 for m in found)


def test_reworded_notice_counts_its_differences():
    (match,) = scan("This project is licensed under the GNU General Public License, version 3.")
    assert (match.license, match.words_different) == ("GPL-3.0", 2)


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("All source files in this repository and its submodules are licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This file is distributed under the terms of the BSD 3-Clause License.", "BSD-3-Clause"),
        ("This is free and unencumbered software released into the\n# public domain.", "Unlicense"),
        (
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "GPL-2.0",
        ),
    ],
)
def test_notices_in_other_places_and_long_forms(text, name):
    (match,) = scan("Words before it. " * 200 + text + " And words after it." * 200)
    assert (match.license, match.words_different) == (name, 0)


def test_every_template_is_found_in_prose_across_lines_and_with_a_changed_word():
    prose = "the quick brown fox and a lazy dog went over to see that river in may of this year while we use it".split()
    rng, right, tried = random.Random(0), 0, 0
    for template in templates():
        for changed in (False, True):
            words = list(template.words)
            if changed:
                words[rng.choice([i for i, w in enumerate(words) if w not in template.required])] = rng.choice(prose)
            around = [[rng.choice(prose) for _ in range(rng.randrange(60))] for _ in range(2)]
            text = "".join(w + rng.choice([" ", " ", "\n", "\n * "]) for w in (*around[0], *words, *around[1]))
            names = [m.license for m in scan(text)]
            assert names in ([], [template.license])
            right, tried = right + bool(names), tried + 1
    assert right >= 0.9 * tried


def test_closest_run_is_the_best_of_all_runs():
    rng = random.Random(1)

    def differences(a, b):
        table = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] if x == y else 1 + min(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(300):
        template, found = rng.choices("abc", k=rng.randrange(1, 6)), rng.choices("abcd", k=rng.randrange(1, 8))
        cover = rng.choice([None, rng.randrange(len(found))])
        runs = [(i, j) for i in range(len(found) + 1) for j in range(i, len(found) + 1) if cover is None or i <= cover < j]
        cost, start, end = closest(template, found, cover)
        least = min(differences(template, found[i:j]) for i, j in runs)
        longest = max(j - i for i, j in runs if differences(template, found[i:j]) == least)
        assert (cost, end - start) == (least, longest)
        assert differences(template, found[start:end]) == cost


@pytest.mark.parametrize(
    ("item", "text", "held"),
    [
        ("What is the capital of France?", "They asked: so, what is the capital of France? Nobody knew.", True),
        ("What is the capital of France?", "One item was what is the capital of Spain, and then it went on.", True),
        ("What is the capital of France?", "France is a country whose capital is what they asked about in the quiz.", False),
        ("too short an", "this is too short an item to be looked for", False),
        # Four values of the item on one value of the document.
        ("A box holds 5 red balls and 7 blue balls and 9 green balls and 4 black balls in all.",
         "A box holds 8 red balls and 8 blue balls and 8 green balls and 8 black balls in all.", False),
        ("A box holds 5 red balls and 7 blue balls and 9 green balls and 4 black balls in all.",
         "A box holds 8 red balls and 3 blue balls and 6 green balls and 2 black balls in all.", True),
    ],
)
def test_short_items_and_conflicts_both_ways(spark, item, text, held):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "an unrelated text of some words")], "doc_id long, text string")
    found = find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in found] == ([1] if held else [])


def test_generated_items_are_found_under_other_values(spark):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("lor", "mip", "tas", "ver", "quo") for b in ("em", "ion", "ule", "and", "ist", "ope")]
    items, rows = [], []
    for i in range(60):
        shape = [rng.choice("wwwn") for _ in range(rng.randrange(12, 30))]
        words = [rng.choice(plain) for _ in shape]
        for copy in range(2):
            values = rng.sample(range(10, 9999), len(shape))
            text = " ".join(str(v) if s == "n" else w for s, w, v in zip(shape, words, values, strict=True))
            if copy:
                rows.append((i, f"{' '.join(rng.choices(plain, k=40))}. {text}. {' '.join(rng.choices(plain, k=40))}"))
            else:
                items.append((i, text))
    rows += [(1000 + i, " ".join(rng.choices(plain, k=100))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(found & {(i, i) for i in range(60)}) >= 54
    assert all(doc == item for doc, item in found)


def _small_network(rng):
    network = Network.start(np.full(CLASSES, 1 / CLASSES, np.float32))
    network.views["out"][:] = rng.normal(0, 1, network.views["out"].shape)
    return network


def _formula(network, tokens):
    """Log likelihood of every token in double precision, token by token."""
    v = {k: a.astype(float) for k, a in network.views.items()}
    for place in tokens.place:
        near = [tokens.padded[place + o] for o in OFFSETS]
        hidden = np.tanh(v["hidden"] + sum(v["tables"][k][t] for k, t in enumerate(near)))
        logits = np.r_[hidden, 1] @ v["out"]
        yield logits[tokens.padded[place]] - np.log(np.exp(logits).sum())


def test_masked_likelihood_is_that_of_the_formula():
    tokens = Tokens.of(np.array([1, 2, 3, 1, 2, 9, 9]), np.array([5, 0, 1, 1]))
    marks = tokens.padded == CLASSES
    assert marks.sum() == 2 * 5 and list(tokens.doc) == [0] * 5 + [2, 3]
    network = _small_network(np.random.default_rng(0))
    assert network.log_likelihoods(tokens) == pytest.approx(list(_formula(network, tokens)), abs=1e-4)


def test_gradient_is_the_slope_of_the_formula():
    rng = np.random.default_rng(1)
    tokens = Tokens.of(rng.integers(0, 6, 60), np.array([20, 1, 39]))
    network = _small_network(rng)
    got = network.gradient(tokens)
    moved = rng.choice(np.flatnonzero(np.abs(got) > 0.1), 25, replace=False)
    for at in moved:
        sides = []
        for step in (1e-3, -1e-3):
            vector = network.vector.astype(float)
            vector[at] += step
            sides.append(-sum(_formula(Network(vector), tokens)))
        assert got[at] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=1e-2, abs=1e-3)


def test_probabilities_of_all_words_of_the_corpus_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr("graphask.llm.masked_lm.KNOWN", 100)
    text = " ".join(f"word{i % 150}{'abc'[i % 3]}" for i in range(2000)) + " once twice thrice 1 22 333"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "once again")], "doc_id long, text string")
    vocabulary, share, tokens = fit_vocabulary(docs)
    assert share.sum() == pytest.approx(1, abs=1e-5) and tokens == 2008 and len(vocabulary.hashes) == 100
    every = sorted({*text.split(), "again"})
    (words,) = pieces(pa.array([" ".join(every)]))
    classes, logs = vocabulary.look_up(bare(words))
    for c in set(classes):
        assert np.exp(logs[classes == c]).sum() == pytest.approx(1, abs=1e-9)


def _sentences(n, seed):
    rng = random.Random(seed)
    kinds = [[f"{kind}{k}" for k in range(30)] for kind in ("noun", "verb", "mark")]
    return [(i, " ".join(rng.choice(kinds[k % 3]) for k in range(rng.randrange(3, 60)))) for i in range(n)]


def test_scores_do_not_depend_on_partitions(spark):
    rows = _sentences(400, 2)
    got = []
    for parts in (1, 8, 64):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got.append([r["per_token"] for r in score_documents(docs).orderBy("doc_id").collect()])
    assert got[1] == pytest.approx(got[0], abs=1e-3) and got[2] == pytest.approx(got[0], abs=1e-3)


def test_every_word_has_its_own_share_of_its_class(spark, monkeypatch):
    monkeypatch.setattr("graphask.llm.masked_lm.KNOWN", 70)
    common = " ".join(f"w{i % 70}a" for i in range(2100))
    # All after the first have one ending, so within a class they differ by their counts alone; the ids repeat.
    rows = [(1, common), (2, "onceqa"), (2, "twiceqa twiceqa"), (None, "thriceqa thriceqa thriceqa"), (3, None), (4, "onceqa thriceqa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary, share, tokens = fit_vocabulary(docs)
    encoded = encode(docs, vocabulary, tokens)
    network = fit_network(encoded, share)
    counts = Counter(word for _, text in rows for word in (text or "").split())
    (every,) = pieces(pa.array([" ".join(counts)]))
    classes = dict(zip(counts, vocabulary.look_up(bare(every))[0], strict=True))
    mass = Counter()
    for word, n in counts.items():
        mass[classes[word]] += n
    expected = []
    for _, text in rows:
        words = (text or "").split()
        of_classes = network.log_likelihoods(Tokens.of(np.array([classes[w] for w in words], int), np.array([len(words)]))).sum()
        expected.append(of_classes + sum(np.log(counts[w] / mass[classes[w]]) for w in words))
    got = score_documents(docs).collect()
    assert sorted(r["pseudo_log_likelihood"] for r in got) == pytest.approx(sorted(expected), abs=1e-3)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)


def test_unseen_texts_are_likelier_than_by_frequencies(spark):
    docs = spark.createDataFrame(_sentences(400, 3), "doc_id long, text string")
    vocabulary, share, n = fit_vocabulary(docs)
    network = fit_network(encode(docs, vocabulary, n), share)
    (words,) = pieces(pa.array([text for _, text in _sentences(100, 4)]))
    plain = bare(words)
    classes, _ = vocabulary.look_up(plain)
    tokens = Tokens.of(classes, np.bincount(plain.doc, minlength=100))
    # The kind of a word follows from its neighbours, which makes it three times as likely.
    assert network.log_likelihoods(tokens).mean() > np.log(share)[classes].mean() + 0.8


def test_training_beats_frequencies_and_orders_texts(spark):
    rng = random.Random(0)
    cycle = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for i in range(60):
        start = rng.randrange(8)
        rows.append((i, " ".join(cycle[(start + k) % 8] for k in range(800))))
    shuffled = rows[0][1].split()
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([*rows, (100, " ".join(shuffled))], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["per_token"] for r in score_documents(docs).collect()}
    assert got[1] > -1.0 and got[100] < got[1] - 1.0
    vocabulary, share, tokens = fit_vocabulary(docs)
    assert share.sum() == pytest.approx(1) and len(vocabulary.hashes) == 8 and tokens == 61 * 800


def test_every_token_of_short_texts_is_trained_on(spark):
    # The pair is never in the first place of a text, and every text has four words.
    rows = [(i, f"start key{i % 8} value{i % 8} end") for i in range(4000)]
    docs = spark.createDataFrame([*rows, (9000, "start key1 value5 end")], "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r["pseudo_log_likelihood"] for r in score_documents(docs).collect()}
    assert min(got[1], got[5]) > got[9000] + 2


def test_pairs_of_terms_decide_toxicity():
    rng = np.random.default_rng(5)
    insult, group, label, docs, terms = rng.random(4000) < 0.5, rng.random(4000) < 0.5, [], [], []
    for i in range(4000):
        label.append(float(insult[i] and group[i]))
        own = [1] * bool(insult[i]) + [2] * bool(group[i]) + [int(rng.integers(10, 200))]
        docs += [i] * len(own)
        terms += own
    model = FactorizationMachine.fit(np.array(docs), np.array(terms), np.array(label))
    again = FactorizationMachine.from_bytes(model.to_bytes())
    scores = again.scores(np.array([0, 1, 2, 2]), np.array([1, 2, 1, 2]), 4)
    assert scores[2] > 0.8 and max(scores[0], scores[1], scores[3]) < 0.5


def test_ordinal_thresholds_and_grades():
    rng = np.random.default_rng(2)
    label = rng.integers(0, 4, 3000)
    doc = np.arange(3000)
    model = OrdinalModel.fit(doc, label + 100, np.ones(3000), label, 4)
    again = OrdinalModel.from_bytes(model.to_bytes(), 4)
    assert (np.diff(again.thresholds) > 0).all()
    tails = again.tails(np.arange(4), np.arange(4) + 100, np.ones(4), 4)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.abs(tails.sum(axis=1) - np.arange(4)).max() < 0.5


def test_rates_meet_targets_and_are_a_projection(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(0, 500, 300)
    members = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(300)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    targets = [0.7, 0.2, 0.1]
    price = fit_rates(members, targets, rounds=2000)
    rates = np.maximum(0, 1 + p @ np.array(price))
    assert np.abs((n * rates) @ p / n.sum() - targets).max() < 1e-6
    # Least squares by brute force: projected gradient on every rate.
    brute, power = np.ones(300), np.zeros(3)
    for _ in range(20_000):
        power -= ((n * brute) @ p / n.sum() - targets) * 0.5
        brute = np.maximum(0, 1 + p @ power)
    assert np.abs(rates - brute)[n > 0].max() < 1e-3


def test_mixture_follows_its_labels(spark):
    rows = [(i, ("the of and to " if i % 4 else "der die und das ") * 20, "en" if i % 4 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = docs.where("doc_id < 100").selectExpr("doc_id", "lang AS domain")
    got = mixing_rates(docs, labelled, {"en": 1.0, "de": 1.0}).groupBy((F.col("doc_id") % 4 == 0).alias("de")).agg(F.avg("rate").alias("r"))
    rates = {r["de"]: r["r"] for r in got.collect()}
    assert rates[True] == pytest.approx(2.0, abs=0.05) and rates[False] == pytest.approx(2 / 3, abs=0.05)


def test_shards_are_contiguous_and_even(spark):
    rng = random.Random(9)
    rows = [(i, "é" * rng.randrange(200)) for i in range(500)]
    rng.shuffle(rows)
    got = sorted(shards(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(s == list(range(len(s))) for s in slots.values()) and len(sizes) == 7
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def test_pipeline_on_the_given_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        counts.append((docs.count(), after.count()))
        assert after.columns == docs.columns
        docs = after
    assert counts[0][0] == 200 and all(a >= b for a, b in counts[:3]) and counts[3][1] >= counts[3][0]
    good = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    right = sum((d in good) == bool(q) for d, q in labels.items())
    assert right >= 0.9 * len(labels)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(placed) == counts[3][1] and {r["shard"] for r in placed} <= set(range(16))
