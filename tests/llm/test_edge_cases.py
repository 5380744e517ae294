"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphask.llm.decontaminate import leak_digest, without_leaks
from graphask.llm.license_scan import scan_licenses
from graphask.llm.masked_lm import score_documents
from graphask.llm.ordinal_quality import keep_good, quality_grades
from graphask.llm.quality_rules import quality_digest
from graphask.llm.secret_scan import secret_digest
from graphask.llm.sharding import shard_digest
from graphask.llm.simhash import one_of_each, simhash_digest
from graphask.llm.soft_mixing import labelled_languages, mixed_without_loss, mixing_rates
from graphask.llm.spelling_variants import spelling_variants
from graphask.llm.suffix_dedup import remove_repeats, repeat_digest
from graphask.llm.toxicity_fm import toxicity_digest

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank"
DOCS_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, row string, "
    "score double, tails string, copy int, hash long, variant string, bucket string"
)
LABELS_SCHEMA = "doc_id long, quality int, toxic int, label string, row string"


def _row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, None, 7, 7, "x", 0.5, "y", 3, 9, "v", "b")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        _row(1, None),
        _row(2, ""),
        _row(3, " \t\n"),
        _row(4, PROSE),
        _row(4, PROSE),
        _row(5, PROSE, None),
        _row(None, PROSE),
        _row(None, None, None),
        _row(6, "word " * 60_000 + "end."),
        _row(7, "x" * 300_000),
        _row(8, "Ünïcödé \U0001f600 text, with §marks§ and 42 km. Released under the MIT License.", "de"),
    ]
    return spark.createDataFrame(rows, DOCS_SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0, "a", "b"), (8, 0, 1, "a", "b"), (8, None, None, None, None), (None, 1, 1, None, None), (99, 1, 0, "", "")]
    return spark.createDataFrame(rows, LABELS_SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, PROSE, 1), (2, None, 1), (3, "", 1), (None, "too short", 1)]
    return spark.createDataFrame(rows, "item_id long, text string, n_windows int")


TARGETS = {"en": 3.0, "de": 1.0}
PER_DOCUMENT = {
    "op1": lambda d, lab, b: quality_digest(d),
    "op2": lambda d, lab, b: simhash_digest(d),
    "op4": lambda d, lab, b: quality_grades(d, lab),
    "op5": lambda d, lab, b: repeat_digest(d),
    "op7": lambda d, lab, b: score_documents(d),
    "op8": lambda d, lab, b: mixing_rates(d, labelled_languages(d, lab), TARGETS),
    "op9": lambda d, lab, b: toxicity_digest(d, lab),
    "op10": lambda d, lab, b: shard_digest(d),
    "op11": lambda d, lab, b: secret_digest(d),
}
SPARSE = {
    "op3": lambda d, lab, b: leak_digest(d, b),
    "op6": lambda d, lab, b: scan_licenses(d),
    "op13": lambda d, lab, b: spelling_variants(d),
}
FILTERS = {
    "good_quality": lambda d, lab, b: keep_good(d, lab),
    "near_duplicates": lambda d, lab, b: one_of_each(d),
    "decontamination": lambda d, lab, b: without_leaks(d, b),
    "mixing": lambda d, lab, b: mixed_without_loss(d, labelled_languages(d, lab), TARGETS),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(name, docs, labels, benchmark):
    got = PER_DOCUMENT[name](docs, labels, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    same = [tuple(r) for r in got if r["doc_id"] == 4]
    if name == "op7":  # sums of single precision, equal up to rounding
        assert same[0] == pytest.approx(same[1], rel=1e-6)
    else:
        assert name == "op10" or same[0] == same[1]


@pytest.mark.parametrize("name", [*PER_DOCUMENT, *SPARSE, *FILTERS])
def test_empty_tables(name, docs, labels, benchmark):
    run = {**PER_DOCUMENT, **SPARSE, **FILTERS}[name]
    assert run(docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_stages_keep_all_columns(name, docs, labels, benchmark):
    assert FILTERS[name](docs, labels, benchmark).columns == docs.columns


def test_defined_results(docs, labels, benchmark):
    quality = {r["doc_id"]: r for r in quality_digest(docs).collect()}
    assert (quality[1]["n_words"], quality[1]["base_failed"], quality[1]["kept"]) == (0, True, False)
    assert (quality[6]["n_words"], quality[6]["n_repeat_words"]) == (60_001, 60_000)

    prints = {r["doc_id"]: r for r in simhash_digest(docs).collect()}
    assert prints[1]["fingerprint"] == prints[3]["fingerprint"] == "0" * 16
    assert prints[1]["component_id"] == prints[2]["component_id"] == 1 and prints[5]["component_id"] == 4

    leaks = leak_digest(docs, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in leaks) == ["4", "5", "None"] and {r["item_id"] for r in leaks} == {1}
    assert without_leaks(docs, benchmark).count() == docs.count() - 4

    removed = {r["doc_id"]: r for r in repeat_digest(docs).collect()}
    assert (removed[4]["n_removed"], removed[5]["n_removed"], removed[None]["n_bytes"]) in [(0, len(PROSE), 0), (0, len(PROSE), len(PROSE))]
    assert removed[6]["n_removed"] == 0 and removed[1]["n_bytes"] == 0

    assert [(r["doc_id"], r["license"]) for r in scan_licenses(docs).collect()] == [(8, "MIT")]
    scores = {r["doc_id"]: r for r in score_documents(docs).collect()}
    assert (scores[2]["n_tokens"], scores[2]["pseudo_log_likelihood"], scores[2]["per_token"]) == (0, 0.0, None)

    placed = shard_digest(docs).collect()
    assert {r["size"] for r in placed if r["doc_id"] in (1, 2)} == {1} and {r["law"] for r in placed} == {"bytes"}


CLEAN = {
    "short": [(1, "short"), (2, "another")],
    "null": [(1, None), (None, None)],
    "one": [(1, "one short text")],
    "empty": [(1, ""), (2, " ")],
    "long": [(1, "abcdefgh " * 3 + PROSE), (2, PROSE[::-1])],
    "spread": [(i, f"text number {i}") for i in range(40)],
}


@pytest.mark.parametrize("case", CLEAN)
@pytest.mark.parametrize("name", [*PER_DOCUMENT, *SPARSE, *FILTERS])
def test_tables_without_repeats_words_or_labels(spark, labels, benchmark, name, case):
    rows = [_row(doc_id, text) for doc_id, text in CLEAN[case]]
    table = spark.createDataFrame(rows, DOCS_SCHEMA)
    got = {**PER_DOCUMENT, **SPARSE, **FILTERS}[name](table, labels, benchmark)
    assert got.count() == len(rows) if name in PER_DOCUMENT else got.count() <= 2 * len(rows)


def test_nothing_is_removed_without_repeats_in_many_blocks(spark):
    table = spark.createDataFrame(CLEAN["spread"] + CLEAN["long"], "doc_id long, text string")
    rows = remove_repeats(table, n_parts=7).collect()
    assert len(rows) == 42 and all(r["spans"] == [] for r in rows)
    assert sorted(r["kept"].decode() for r in rows) == sorted(t for _, t in CLEAN["spread"] + CLEAN["long"])


def test_one_of_each_keeps_one_copy_and_rows_without_id(docs):
    ids = sorted(str(r["doc_id"]) for r in one_of_each(docs).collect())
    assert ids == sorted(["1", "4", "6", "7", "8", "None", "None"])


def test_pipeline_stages_are_the_dealt_ones():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["ordinal_quality", "simhash", "decontamination", "soft_mixing", "sharding"]


def test_labels_without_rows_leave_scores_defined(docs, labels):
    scored = toxicity_digest(docs, labels.limit(0))
    assert scored.where(F.col("score").isNull()).count() == 0
    assert quality_grades(docs, labels.limit(0)).where("kept IS NULL").count() == 0
