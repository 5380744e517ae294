"""Question table in, answer table out.

Analysis runs once per question; lookups run once per distinct ask, however
many questions share it; the answers then travel back with hot asks salted, and
the questions that share a long answer are dealt to tasks of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphask.functions import answers as an
from graphask.functions import text as tx
from graphask.operators.classifiers import FITTERS, TemplateClassifier, best_fitter, compare_fitters
from graphask.operators.features import labeled_points, vocabulary_words
from graphask.operators.graph import NAMES_PER_PART, Graph, Routed, route
from graphask.operators.tagging import NO_VARIANTS, Lexicon, match_spans
from graphask.plans.catalog import TemplateCatalog
from graphask.plans.lineage import cut_lineage, stored
from graphask.plans.long_texts import join_long_texts
from graphask.plans.skew import ROWS_PER_TASK, find_hot_keys, salted_join

_ASK = ["template_id", "slot_name"]


@dataclass(frozen=True)
class QuestionEngine:
    """Everything a batch needs; built once, used for any number of batches."""

    graph: Graph
    catalog: TemplateCatalog
    lexicon: Lexicon
    classifier: TemplateClassifier
    names_per_part: int = NAMES_PER_PART
    rows_per_task: int = ROWS_PER_TASK

    def with_dictionary(self, dictionary: DataFrame) -> QuestionEngine:
        """The same engine with other entities; its classifier knows only their tags, so it stays as trained."""
        return replace(self, lexicon=self.lexicon.with_dictionary(dictionary))

    def analyze(self, questions: DataFrame) -> DataFrame:
        """``question_id, template_id, pattern, slot1, slot2, slot_name, has_slot, well_formed, n_hits,
        max_probability``; columns that are not used further on are not computed."""
        matched = match_spans(questions.select("question_id", "text"), self.lexicon)
        words = matched.select(
            "question_id",
            tx.merge_words(F.col("tokens"), F.col("spans")).alias("words"),
            tx.mention_map(F.col("spans")).alias("mentions"),
        )
        scored = self.classifier.score(words).withColumnRenamed("prediction", "template_id")
        templates = F.broadcast(self.catalog.to_df(questions.sparkSession))
        filled = scored.join(templates, "template_id", "left").withColumns({
            "filled": tx.fill_template(F.col("pattern"), F.col("mentions")),
            "mention": F.try_element_at("mentions", "slot_tag"),
        })
        return filled.select(
            "question_id",
            "template_id",
            "pattern",
            tx.slot(F.col("filled"), 1).alias("slot1"),
            tx.slot(F.col("filled"), 2).alias("slot2"),
            F.coalesce("mention", F.lit("")).alias("slot_name"),
            F.col("mention").isNotNull().alias("has_slot"),
            F.col("kind").isNotNull().alias("well_formed"),
            "n_hits",
            "max_probability",
        )

    def answer_asks(self, asks: DataFrame) -> Routed:
        """Answers of distinct asks ``template_id, slot_name``, one row per answer part.

        An ask without a slot has an empty name.
        """
        routed, long_asks = route(asks, self.graph, self.catalog, self.names_per_part)
        status = an.status_of(F.col("raw_answer"), F.col("slot_name") != "", F.col("well_formed"))
        answers = routed.withColumn("status", status).select(
            *_ASK,
            "part_no",
            "n_parts",
            "match_count",
            an.answer_text(F.col("raw_answer"), F.col("status")).alias("answer"),
            "status",
        )
        return Routed(answers, long_asks)

    def _ask(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The analysed questions, materialised, and the count of each distinct ask."""
        analyzed = self.analyze(questions)
        asked = cut_lineage(analyzed.select("question_id", "template_id", "slot1", "slot2", "slot_name"))
        return asked, asked.groupBy(*_ASK).agg(F.count(F.lit(1)).alias("n"))

    def answer_normalized(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Two tables that grow with the questions and with the distinct asks only.

        ``question_id, template_id, slot1, slot2, slot_name`` and the answer
        parts per ``template_id, slot_name``. Use these where long lists are
        asked for often; their join is :meth:`answer`.
        """
        asked, counts = self._ask(questions)
        return asked, self.answer_asks(counts).answers

    def answer(self, questions: DataFrame) -> DataFrame:
        """``question_id, template_id, slot1, slot2, part_no, n_parts, match_count, answer, status``."""
        asked, counts = self._ask(questions)
        answers, long_asks = self.answer_asks(counts)
        answers = stored(answers, "answers")
        hot = find_hot_keys(counts, _ASK, rows_per_task=self.rows_per_task)
        keys = _ASK
        if long_asks is not None:
            # One row per question and part, so the parts of one long answer meet their questions in many tasks.
            numbered = salted_join(asked, long_asks, _ASK, hot, "question_id", "left")
            last_part = F.coalesce(F.col("n_parts"), F.lit(1)) - 1
            asked = numbered.withColumn("part_no", F.explode(F.sequence(F.lit(0), last_part))).drop("n_parts")
            keys = [*_ASK, "part_no"]
        joined = join_long_texts(asked, answers, keys, "answer", counts, hot, "question_id", self.rows_per_task)
        return joined.select(
            "question_id", "template_id", "slot1", "slot2", "part_no", "n_parts", "match_count", "answer", "status"
        )


def build_engine(
    spark: SparkSession,
    nodes: DataFrame,
    edges: DataFrame,
    dictionary: DataFrame,
    vocabulary: DataFrame,
    samples: DataFrame,
    catalog: TemplateCatalog,
    variants: tuple[str, str] = NO_VARIANTS,
    classifier: str = "naive_bayes",
) -> QuestionEngine:
    """Train on ``samples`` and prepare the lookups.

    The samples go through the same tagging as the questions, so training and
    scoring see the same words. ``classifier`` names a trainer, or is ``best``: then
    all are compared on a held-out fifth of the phrasings, and the winner is trained
    on all of them. :func:`classifier_accuracy` returns that comparison.
    """
    lexicon = Lexicon(dictionary, vocabulary, variants)
    words = vocabulary_words(vocabulary, variants)
    points = labeled_points(samples, words, lexicon)
    name = best_fitter(compare_fitters(points, words)) if classifier == "best" else classifier
    return QuestionEngine(Graph(nodes, edges), catalog, lexicon, FITTERS[name](points, words))


def classifier_accuracy(
    dictionary: DataFrame, vocabulary: DataFrame, samples: DataFrame, variants: tuple[str, str] = NO_VARIANTS
) -> DataFrame:
    """``model, n_test, accuracy`` of every trainer on one held-out fifth of the phrasings."""
    words = vocabulary_words(vocabulary, variants)
    return compare_fitters(labeled_points(samples, words, Lexicon(dictionary, vocabulary, variants)), words)
