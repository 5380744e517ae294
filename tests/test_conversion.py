"""Phrase conversion against a plain left-to-right replacement."""

import random

import pytest

from graphask.operators.conversion import ConversionTable, convert_phrases

ENTRIES = "source string, target string, load_order long"


def _replaced(text, table):
    out, at = [], 0
    while at < len(text):
        for length in range(max(map(len, table), default=0), 0, -1):
            if text[at : at + length] in table and at + length <= len(text):
                out.append(table[text[at : at + length]])
                at += length
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_longest_entries_are_replaced_from_the_left(spark, limit):
    rng = random.Random(2)
    letters = "a b發𠀀髮"
    table = {"".join(rng.choices(letters, k=rng.randint(1, 4))): "".join(rng.choices("xyz 发", k=rng.randint(0, 5))) for _ in range(25)}
    texts = {i: "".join(rng.choices(letters, k=rng.randint(0, 40))) for i in range(60)}
    entries = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(table.items())], ENTRIES)
    docs = spark.createDataFrame(list(texts.items()), "question_id long, text string")
    got = {r["question_id"]: r["text"] for r in convert_phrases(docs, ConversionTable(entries, max_rows=limit)).collect()}
    assert got == {i: _replaced(text, table) for i, text in texts.items()}


def test_phrases_that_change_their_length(spark):
    rows = [("以後", "以后", 0), ("皇后", "皇后", 0), ("滑鼠", "鼠标器", 0), ("後", "后", 0), ("滑鼠", "鼠标", 1), ("", "x", 0), ("魚", None, 0)]
    entries = spark.createDataFrame(rows, ENTRIES)
    docs = spark.createDataFrame(
        [(1, "滑鼠以後給皇后", 5), (2, None, 6), (3, "", 7), (4, "魚", 8)], "question_id long, text string, other int"
    )
    got = {r["question_id"]: (r["text"], r["other"]) for r in convert_phrases(docs, ConversionTable(entries)).collect()}
    assert got == {1: ("鼠标器以后給皇后", 5), 2: (None, 6), 3: ("", 7), 4: ("魚", 8)}


def test_an_empty_table_changes_nothing(spark):
    docs = spark.createDataFrame([(1, "as it is")], "question_id long, text string")
    converted = convert_phrases(docs, ConversionTable(spark.createDataFrame([], ENTRIES)))
    assert [tuple(r) for r in converted.collect()] == [(1, "as it is")]
