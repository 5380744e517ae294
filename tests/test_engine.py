import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from aquaculture import SAMPLES, TEMPLATE_IDS, tables
from graphask import Template, TemplateCatalog, aquaculture_catalog, build_engine, schemas
from graphask.operators.classifiers import best_fitter, compare_fitters
from graphask.plans.answer_questions import QuestionEngine
from graphask.sources import read_answers, stream_questions, write_answers
from graphask.streaming import answer_stream
from test_graph import EXPECTED

NAMES = {"nap": "草鱼", "nba": "水草", "ndi": "赤皮病", "neq": "潜水泵", "nha": "江", "nve": "草鱼塘", "napl": "草鱼鱼苗"}


@pytest.fixture(scope="module")
def engine(spark):
    return build_engine(spark, catalog=aquaculture_catalog(), **tables(spark))


def sentence(text):
    for tag in sorted(NAMES, key=len, reverse=True):
        text = text.replace(tag, NAMES[tag])
    return text


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, sentence(text)) for i, (_, text) in enumerate(SAMPLES)]
    rows += [(900, "鲫鱼住在哪里"), (901, "它住在哪里"), (902, "水库里有什么鱼"), (903, ""), (904, "鲤鱼俗称是什么"), (905, None)]
    return spark.createDataFrame(rows, schemas.QUESTIONS)


@pytest.fixture(scope="module")
def answers(engine, questions):
    return {r["question_id"]: r for r in engine.answer(questions).collect()}


def test_every_phrasing_is_answered(answers):
    wrong = []
    for i, (template, text) in enumerate(SAMPLES):
        row = answers[i]
        if row["template_id"] != template or row["answer"] != EXPECTED[template][1] or row["status"] != "ok":
            wrong.append((text, template, row))
    assert not wrong
    assert {t for t, _ in SAMPLES} == set(TEMPLATE_IDS)


def test_questions_without_an_answer(answers):
    assert (answers[900]["status"], answers[900]["slot1"]) == ("not_found", "鲫鱼")
    assert (answers[901]["status"], answers[901]["slot1"]) == ("no_slot", "nap")
    assert answers[902]["status"] == "not_found"
    assert answers[903]["status"] == answers[905]["status"] == "no_slot"
    assert answers[904]["status"] == "not_found"
    assert {answers[i]["answer"] for i in range(900, 906)} == {"抱歉,我没有找到你要的答案"}


def test_analysis_columns(engine, questions):
    row = engine.analyze(questions.where("question_id = 0")).first()
    assert (row["template_id"], row["slot1"], row["slot2"]) == (0, "草鱼", "别名")
    assert row["n_hits"] > 0 and 0 < row["max_probability"] <= 1


def test_unknown_template_is_an_error_not_a_failure(spark, engine, questions):
    partial = TemplateCatalog(aquaculture_catalog().templates[:1])
    narrow = QuestionEngine(engine.graph, partial, engine.lexicon, engine.classifier)
    rows = narrow.answer(questions).collect()
    assert len(rows) == questions.count()
    got = {r["question_id"]: (r["status"], r["answer"]) for r in rows}
    assert got[0] == ("ok", "鲩鱼")
    assert got[10] == ("error", "系统繁忙，请稍后重试...")


def test_hot_asks_are_spread(spark, engine, questions, answers):
    """Most questions share one ask; the salted way back gives the same rows."""
    repeated = questions.where("question_id in (0, 4)").select(
        F.explode(F.sequence(F.lit(1000), F.lit(1099))).alias("n"), "question_id", "text"
    ).select((F.col("n") * 10 + F.col("question_id")).alias("question_id"), "text")
    spread = QuestionEngine(engine.graph, engine.catalog, engine.lexicon, engine.classifier, rows_per_task=10)
    rows = spread.answer(questions.unionByName(repeated)).collect()
    assert len(rows) == questions.count() + 200
    for row in rows:
        source = row["question_id"] if row["question_id"] < 10000 else row["question_id"] % 10
        assert row["answer"] == answers[source]["answer"]


def test_long_answers_come_in_parts(spark, engine, questions, answers):
    """Lists of two names in parts of one name, with hot asks: every part reaches every question."""
    split = QuestionEngine(
        engine.graph, engine.catalog, engine.lexicon, engine.classifier, names_per_part=1, rows_per_task=1
    )
    rows = split.answer(questions).collect()
    names = {}
    for row in rows:
        names.setdefault(row["question_id"], []).append(row["answer"])
    assert set(names) == set(answers)
    for question_id, row in answers.items():
        if row["status"] == "ok" and 18 <= row["template_id"] <= 24:
            assert sorted("、".join(names[question_id]).split("、")) == row["answer"].split("、")
        else:
            assert names[question_id] == [row["answer"]]


def test_normalized_tables_join_to_the_answers(engine, questions, answers):
    asked, parts = engine.answer_normalized(questions)
    assert asked.count() == questions.count()
    assert parts.count() < asked.count()
    joined = asked.join(parts, ["template_id", "slot_name"])
    assert {r["question_id"]: r["answer"] for r in joined.collect()} == {k: v["answer"] for k, v in answers.items()}


def test_partitioning_changes_nothing(engine, questions, answers):
    rows = engine.answer(questions.repartition(11)).collect()
    assert {r["question_id"]: tuple(r) for r in rows} == {k: tuple(v) for k, v in answers.items()}


def test_stream_equals_batch(spark, tmp_path, engine, questions, answers):
    source = str(tmp_path / "in")
    questions.repartition(3).write.parquet(source)
    arriving = stream_questions(spark, source, max_files_per_trigger=1)
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    answer_stream(arriving, engine, path, state, available_now=True).awaitTermination()
    out = spark.read.parquet(path)
    assert out.select("batch_id").distinct().count() == 3
    assert {r["question_id"]: r["answer"] for r in out.collect()} == {k: v["answer"] for k, v in answers.items()}

    questions.limit(2).withColumn("question_id", F.col("question_id") + 5000).coalesce(1).write.mode("append").parquet(source)
    answer_stream(arriving, engine, path, state, available_now=True).awaitTermination()
    assert spark.read.parquet(path).count() == questions.count() + 2


def test_answer_sink(spark, tmp_path, engine, questions, answers):
    path = str(tmp_path / "answers")
    write_answers(engine.answer(questions), path)
    assert read_answers(spark, path).count() == len(answers)


def test_catalog_is_bounded():
    rows = [Template(i, "nap x", "property", "l", "f", None, 1) for i in range(10_001)]
    with pytest.raises(ValueError, match="templates"):
        TemplateCatalog(rows)


def test_engine_with_another_classifier(spark):
    given = tables(spark)
    engine = build_engine(spark, catalog=aquaculture_catalog(), classifier="decision_tree", **given)
    assert engine.classifier.name == "decision_tree"
    asked = spark.createDataFrame([(1, sentence(SAMPLES[0][1]))], schemas.QUESTIONS)
    assert engine.analyze(asked).first()["template_id"] in TEMPLATE_IDS


def test_trainers_are_compared_on_one_split(spark):
    rows = [(k % 2, f"s{k}", float(k % 2), [1.0 - k % 2, float(k % 2)]) for k in range(60)]
    points = spark.createDataFrame(rows, "label int, sentence string, x double, v array<double>").select(
        "label", "sentence", array_to_vector("v").alias("features")
    )
    compared = compare_fitters(points, ["a", "b"])
    scores = {r["model"]: (r["n_test"], r["accuracy"]) for r in compared.collect()}
    assert set(scores) == {"naive_bayes", "decision_tree", "boosted"} and len({n for n, _ in scores.values()}) == 1
    assert scores["naive_bayes"][1] == 1.0 and best_fitter(compared) == "naive_bayes"
