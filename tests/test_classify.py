import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from graphask.examples import star_schema
from graphask.examples.queries import QUERIES
from graphask.operators import classifiers as cl
from graphask.operators import naive_bayes as nb
from graphask.operators.features import feature_hits, labeled_points, vectorize, vocabulary_words

TWO = (
    [(1, Vectors.dense(1, 0, 1, 0, 1, 0)), (2, Vectors.sparse(6, [0, 1, 2, 3, 5], [1.0] * 5)),
     (2, Vectors.dense(0, 1, 1, 1, 0, 1))],
    Vectors.dense(0, 0, 0, 0, 1, 0), 1, [0.6897, 0.3103],
)
THREE = (
    [(1, Vectors.dense(1, 0, 2)), (2, Vectors.sparse(3, [0, 1], [2.0, 3.0])), (3, Vectors.dense(1, 1, 2))],
    Vectors.dense(2, 1, 0), 2, [0.1651, 0.6269, 0.2080],
)


@pytest.mark.parametrize("case", [TWO, THREE], ids=["binary", "counts"])
def test_known_naive_bayes_results(spark, case):
    train, query, expected, posterior = case
    points = spark.createDataFrame(train, ["label", "features"])
    model = cl.fit_naive_bayes(points, [])
    row = model.predict(spark.createDataFrame([(query,)], ["features"])).first()
    assert row["prediction"] == expected
    assert [round(p, 4) for p in row["probability"]] == pytest.approx(posterior, abs=1e-4)

    hits = [(i, label, j, float(v)) for i, (label, x) in enumerate(train) for j, v in enumerate(x.toArray()) if v]
    long = spark.createDataFrame(hits, "id int, label int, idx int, value double")
    labelled = spark.createDataFrame([(label,) for label, _ in train], "label int")
    vocabulary = spark.range(len(query)).select(F.col("id").cast("int").alias("idx"))
    table = nb.fit_table(long, labelled, vocabulary, value="value")
    asked = spark.createDataFrame([(0, j, float(v)) for j, v in enumerate(query.toArray()) if v], "id int, idx int, value double")
    scores = nb.score_table(table, spark.createDataFrame([(0,), (1,)], "id int"), asked, "id", value="value")
    got = {
        r["id"]: (r["label"], r["p"])
        for r in scores.select(
            "id", nb.argmax_label(table, F.col("scores")).alias("label"), nb.probabilities(F.col("scores")).alias("p")
        ).collect()
    }
    assert got[0][0] == expected
    assert got[0][1] == pytest.approx(posterior, abs=1e-4)
    assert sum(got[1][1]) == pytest.approx(1.0)  # a text without hits keeps the priors


def test_labels_with_a_hole(spark):
    points = spark.createDataFrame([(0, Vectors.dense(1, 0)), (2, Vectors.dense(0, 1))], ["label", "features"])
    for name in ("naive_bayes", "decision_tree"):
        predicted = cl.FITTERS[name](points, []).predict(points)
        assert predicted.where("prediction <> label").count() == 0


def test_dense_equals_sparse(spark):
    dense = [(k, Vectors.dense(x)) for k, x in [(0, [1, 0, 1]), (1, [0, 1, 0]), (1, [0, 1, 1])]]
    sparse = [(k, Vectors.sparse(3, [(i, v) for i, v in enumerate(x.toArray()) if v])) for k, x in dense]
    results = []
    for rows in (dense, sparse):
        points = spark.createDataFrame(rows, ["label", "features"])
        results.append([r["probability"] for r in cl.fit_naive_bayes(points, []).predict(points).collect()])
    assert results[0] == results[1]


def test_features_agree_in_both_forms(spark):
    words = ["fish", "what", "eats"]
    texts = spark.createDataFrame(
        [(0, ["what", "eats", "what", "x"]), (1, []), (2, ["fish"])], "id int, words array<string>"
    )
    vocabulary = spark.createDataFrame(list(enumerate(words)), "idx int, word string")
    assert vocabulary_words(vocabulary) == words
    vectors = {r["id"]: r["features"] for r in vectorize(texts, words).collect()}
    assert vectors[0] == Vectors.sparse(3, [1, 2], [1.0, 1.0])
    assert vectors[1].numNonzeros() == 0
    assert {tuple(r) for r in feature_hits(texts, vocabulary, "id").collect()} == {(0, 1), (0, 2), (2, 0)}
    counts = feature_hits(texts, vocabulary, "id", binary=False)
    assert {tuple(r) for r in counts.collect()} == {(0, 1, 2.0), (0, 2, 1.0), (2, 0, 1.0)}


def test_vocabulary_limit_and_empty_corpus(spark):
    vocabulary = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, word string")
    with pytest.raises(ValueError, match="over the limit"):
        vocabulary_words(vocabulary, max_words=1)
    with pytest.raises(ValueError, match="no training samples"):
        labeled_points(spark.createDataFrame([], "label int, sentence string"), ["a"])


def corpus(spark):
    names = {0: ["red", "rose", "petal"], 1: ["blue", "whale", "sea"], 3: ["green", "leaf", "tree"]}
    rows = [
        (k * 1000 + i, k, [words[i % 3], words[(i // 3) % 3], f"noise{i % 7}"])
        for k, words in names.items()
        for i in range(40)
    ]
    words = [w for ws in names.values() for w in ws] + [f"noise{i}" for i in range(7)]
    points = vectorize(spark.createDataFrame(rows, "id long, label int, words array<string>"), words)
    return points.select("id", "label", "features"), words


def test_split_is_stable(spark):
    points, _ = corpus(spark)
    train, test = cl.split_by_key(points, "id")
    ids = {r[0] for r in train.select("id").collect()}
    again = {r[0] for r in cl.split_by_key(points.repartition(9), "id")[0].select("id").collect()}
    assert ids == again
    assert len(ids) + test.count() == points.count()
    assert 0.7 < len(ids) / points.count() < 0.9


def test_three_models_and_selection(spark):
    points, words = corpus(spark)
    train, test = cl.split_by_key(points, "id")
    models = [fit(train, words) for fit in cl.FITTERS.values()]
    for model in models:
        predicted = model.predict(test)
        assert cl.accuracy(predicted).first()["accuracy"] >= 0.95
        for row in predicted.collect():
            assert sum(row["probability"]) == pytest.approx(1.0)
            assert model.labels[row["probability"].index(max(row["probability"]))] == row["prediction"]
    assert [m.name for m in models] == ["naive_bayes", "decision_tree", "boosted"]
    assert cl.select_model(models, test).name in cl.FITTERS
    assert cl.compare_models(models, test).count() == 3


@pytest.mark.parametrize("name", list(cl.FITTERS))
def test_saved_model_keeps_labels_and_words(spark, tmp_path, name):
    points, words = corpus(spark)
    model = cl.FITTERS[name](points, words)
    model.save(str(tmp_path / "m"))
    loaded = cl.TemplateClassifier.load(spark, str(tmp_path / "m"))
    assert (loaded.name, loaded.labels, loaded.words) == (name, [0, 1, 3], words)
    same = model.predict(points).select("id", "prediction").exceptAll(loaded.predict(points).select("id", "prediction"))
    assert same.isEmpty()


def test_scoring_reports_hits(spark):
    points, words = corpus(spark)
    model = cl.fit_naive_bayes(points, words)
    asked = spark.createDataFrame([(0, ["red", "red", "rose"]), (1, ["unknown"])], "id int, words array<string>")
    got = {r["id"]: r for r in model.score(asked).collect()}
    assert got[0]["n_hits"] == 2 and got[0]["prediction"] == 0
    assert got[1]["n_hits"] == 0 and got[1]["max_probability"] == pytest.approx(1 / 3, abs=1e-6)


def test_scoring_has_no_shuffle_and_no_python(spark):
    points, words = corpus(spark)
    model = cl.fit_naive_bayes(points, words)
    asked = spark.createDataFrame([(0, ["red"])], "id int, words array<string>")
    plan = model.score(asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_template_lookup(spark):
    predictions = spark.createDataFrame([(1, 0), (2, 5)], "id int, prediction int")
    templates = spark.createDataFrame([(0, "nap 别名")], "template_id int, pattern string")
    got = {r["id"]: r["pattern"] for r in cl.lookup_templates(predictions, templates).collect()}
    assert got == {1: "nap 别名", 2: None}


def test_copies_count_as_weight(spark):
    rows = [(0, "a"), (0, "a"), (0, "b"), (1, "b")]
    samples = spark.createDataFrame(rows, "label int, sentence string")
    points = labeled_points(samples, ["a", "b"])
    weighted = cl.fit_naive_bayes(points, ["a", "b"]).model
    plain = vectorize(samples.select("label", F.array("sentence").alias("words")), ["a", "b"])
    repeated = cl.fit_naive_bayes(plain.select("label", "features"), ["a", "b"]).model
    assert weighted.pi == repeated.pi and weighted.theta == repeated.theta


def test_document_counts_are_written_once_and_scored(spark, tmp_path):
    """The scores read the stored counts, not the texts once more, and are those of the formula."""
    docs = [(0, "red red blue", "en"), (1, "green", "en"), (2, "", "en"), (3, "blue green green", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    scored = QUERIES["ml_naive_bayes_counts"](spark, str(tmp_path))
    assert any("document-counts" in file for file in scored.inputFiles())
    first = {"red": 3 / 6, "blue": 2 / 6, "green": 1 / 6}
    second = {"red": 1 / 4, "blue": 1 / 4, "green": 2 / 4}
    got = {r["doc_id"]: r["p_first"] for r in scored.collect()}
    for doc_id, text, _ in docs:
        a, b = (math.prod(chance[word] for word in text.split()) for chance in (first, second))
        assert got[doc_id] == pytest.approx(a / (a + b), abs=2e-6)


def test_documents_are_tokenized_once(spark, tmp_path, monkeypatch):
    """The words are written once; what passes over them several times reads those."""
    texts = [(i, ("a b c", "b c d d", "", None)[i % 4], ("en", "fr", None)[i % 3]) for i in range(24)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    read, written = {}, star_schema.stored
    monkeypatch.setattr(star_schema, "stored", lambda df, name: read.update({name: df.inputFiles()}) or written(df, name))
    star = star_schema.StarSchema(spark, str(tmp_path))
    hits = sorted((row["doc_id"], row["idx"]) for row in star.document_hits.collect())
    assert hits == sorted((i, ord(w) - ord("a")) for i, text, _ in texts for w in sorted(set((text or "").split())))
    assert [name for name, files in read.items() if any("documents.parquet" in file for file in files)] == ["document-words"]
    assert sorted(read) == ["document-hits", "document-vocabulary", "document-words"]
