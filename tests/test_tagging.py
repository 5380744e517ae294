import random

import pytest
from pyspark.sql import functions as F

from graphask import schemas
from graphask.operators import tagging
from graphask.operators.tagging import Lexicon, explode_terms, highest_tag, last_mentions, tag_entities
from graphask.plans import skew


def terms_of(spark, dictionary, texts, vocabulary=None, **limits):
    words = spark.createDataFrame(dictionary, schemas.DICTIONARY)
    questions = spark.createDataFrame(list(enumerate(texts)), schemas.QUESTIONS)
    vocab = None if vocabulary is None else spark.createDataFrame(vocabulary, schemas.VOCABULARY)
    tagged = tag_entities(questions, Lexicon(words, vocab, **limits))
    return {r["question_id"]: [(t["pos"], t["word"], t["tag"]) for t in r["terms"]] for r in tagged.collect()}


def test_longest_entry_wins_and_first_dictionary_wins(spark):
    dictionary = [("a", "t1", 0, 0), ("a b", "t2", 0, 1), ("b c", "t3", 0, 1), ("a", "t9", 0, 2)]
    got = terms_of(spark, dictionary, ["a b c a", "x", "", "b c"])
    assert got[0] == [(0, "a b", "t2"), (2, "c", None), (3, "a", "t1")]
    assert got[1] == [(0, "x", None)]
    assert got[2] == []
    assert got[3] == [(0, "b c", "t3")]


def test_unspaced_text_with_nested_names(spark):
    dictionary = [("草鱼", "nap", 0, 0), ("草鱼鱼苗", "napl", 0, 6), ("草鱼塘", "nve", 0, 5)]
    got = terms_of(spark, dictionary, ["草鱼鱼苗在草鱼塘吃什么"], [(0, "什么"), (1, "吃")])
    assert [(w, t) for _, w, t in got[0]] == [
        ("草鱼鱼苗", "napl"), ("在", None), ("草鱼塘", "nve"), ("吃", None), ("什么", None),
    ]


def test_forced_word_is_one_term(spark):
    got = terms_of(spark, [("虽然会", "ng", 0, 0)], ["明天虽然会下雨，但是我还是会看演唱会。"])
    assert ("虽然会", "ng") in [(w, t) for _, w, t in got[0]]


def test_tag_test_is_not_a_substring_test(spark):
    got = terms_of(spark, [("fish", "nap", 0, 0)], ["nba finals fish"])
    assert got[0] == [(0, "nba", None), (1, "finals", None), (2, "fish", "nap")]


def brute_force(tokens, lexicon):
    out, i = [], 0
    while i < len(tokens):
        for k in (3, 2, 1):
            phrase = " ".join(tokens[i : i + k])
            if len(tokens) - i >= k and phrase in lexicon:
                out.append((i, phrase, lexicon[phrase]))
                i += k
                break
        else:
            out.append((i, tokens[i], None))
            i += 1
    return out


@pytest.fixture(scope="module")
def random_case():
    rng = random.Random(7)
    letters = "abcd"
    lexicon = {}
    for _ in range(25):
        phrase = " ".join(rng.choices(letters, k=rng.randint(1, 3)))
        lexicon.setdefault(phrase, f"t{len(lexicon) % 3}")
    texts = [" ".join(rng.choices(letters + "xyz", k=rng.randint(0, 200))) for _ in range(60)]
    return lexicon, texts


def test_matches_brute_force(spark, random_case):
    lexicon, texts = random_case
    dictionary = [(w, t, 0, i) for i, (w, t) in enumerate(lexicon.items())]
    got = terms_of(spark, dictionary, texts)
    for i, text in enumerate(texts):
        assert got[i] == brute_force(text.split(), lexicon)


def test_shuffled_dictionary_with_hot_phrases(spark, random_case, monkeypatch):
    """The path beyond the broadcast limit, every phrase of the texts being hot."""
    lexicon, texts = random_case
    dictionary = [(w, t, 0, i) for i, (w, t) in enumerate(lexicon.items())]
    small = lambda counts, keys: skew.find_hot_keys(counts, keys, rows_per_task=20)
    monkeypatch.setattr(tagging, "find_hot_keys", small)
    got = terms_of(spark, dictionary, texts, max_rows=0)
    for i, text in enumerate(texts):
        assert got[i] == brute_force(text.split(), lexicon)


@pytest.mark.parametrize("limits", [{}, {"max_rows": 0}], ids=["broadcast", "shuffled"])
def test_tokens_that_start_no_entry_do_not_grow(spark, limits):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(common, k=200)) for _ in range(20)] + ["w1 w2 w3 w1 w2", "", "w1"]
    dictionary = [("w1 w2 w3", "t", 0, 0), ("w1", "t", 0, 0), ("w7 w8", "t", 0, 0)]
    lexicon = Lexicon(spark.createDataFrame(dictionary, schemas.DICTIONARY), **limits)
    questions = spark.createDataFrame(list(enumerate(texts)), schemas.QUESTIONS)
    tokens = questions.select("question_id", F.split("text", " ").alias("tokens"))
    grown = {tuple(r) for r in tagging.candidate_phrases(tokens, lexicon, "question_id").collect()}
    lengths = {"w1": (1, 3), "w7": (2,)}
    want = {
        (i, at, k, " ".join(words[at : at + k]))
        for i, words in enumerate(t.split(" ") for t in texts)
        for at, word in enumerate(words)
        for k in lengths.get(word, ())
        if at + k <= len(words)
    }
    every = sum(max(0, len(t.split(" ")) - k + 1) for t in texts for k in (1, 2, 3))
    assert grown == want and 10 * len(grown) < every
    hits = tagging.find_mentions(questions, lexicon).select("question_id", "start", "len").collect()
    phrases = {w for w, *_ in dictionary}
    assert {tuple(r) for r in hits} == {(i, at, k) for i, at, k, phrase in want if phrase in phrases}


def test_unrelated_words_and_partitioning_change_nothing(spark):
    texts = [f"who sells a b to c{i}" for i in range(40)]
    base = [("a b", "t", 0, 0)]
    more = base + [(f"zz{i} yy", "u", 0, 1) for i in range(50)]
    assert terms_of(spark, base, texts) == terms_of(spark, more, texts)
    questions = spark.createDataFrame(list(enumerate(texts)), schemas.QUESTIONS)
    lexicon = Lexicon(spark.createDataFrame(base, schemas.DICTIONARY))
    spread = {r[0]: r["terms"] for r in tag_entities(questions.repartition(7), lexicon).collect()}
    packed = {r[0]: r["terms"] for r in tag_entities(questions.coalesce(1), lexicon).collect()}
    assert spread == packed


def test_table_forms(spark):
    questions = spark.createDataFrame([(1, "a x b a2")], schemas.QUESTIONS)
    words = spark.createDataFrame(
        [("a", "t1", 0, 0), ("a2", "t1", 0, 0), ("b", "t10", 0, 0)], schemas.DICTIONARY
    )
    tagged = tag_entities(questions, Lexicon(words))
    assert {tuple(r) for r in last_mentions(explode_terms(tagged)).collect()} == {(1, "t1", "a2"), (1, "t10", "b")}
    order = lambda *tags: tagged.select(highest_tag(F.col("terms"), tags)).first()[0]
    assert order("t10", "t1") == "t10"
    assert order("t1", "t10") == "t1"
    assert order("t2") is None


def test_no_text_shuffle_when_bucketed(spark):
    questions = spark.createDataFrame([(i, f"a {i}") for i in range(50)], schemas.QUESTIONS)
    questions.write.mode("overwrite").bucketBy(4, "question_id").saveAsTable("bucketed_questions")
    try:
        lexicon = Lexicon(spark.createDataFrame([("a", "t", 0, 0)], schemas.DICTIONARY))
        tagged = tag_entities(spark.table("bucketed_questions"), lexicon)
        plan = tagged._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(question_id" not in plan
        assert tagged.count() == 50
    finally:
        spark.sql("DROP TABLE bucketed_questions")
