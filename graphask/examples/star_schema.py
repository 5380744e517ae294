"""A graph, a dictionary, a corpus and questions derived from star-schema tables.

The SQL is valid in Spark and in DuckDB; names in braces are tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphask.functions import text as tx
from graphask.operators.features import feature_hits, labeled_points, vocabulary_words
from graphask.operators.classifiers import fit_naive_bayes
from graphask.operators.graph import Graph
from graphask.operators.tagging import Lexicon
from graphask.operators.trees import sparse_points
from graphask.plans.answer_questions import QuestionEngine
from graphask.plans import with_position
from graphask.plans.lineage import stored
from graphask.plans.catalog import INBOUND, PROPERTY, RECORD, Template, TemplateCatalog
from graphask.sources import parse_dictionary, props_from_columns, union_dictionaries

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

NODES_SQL = """
SELECT 1000000000 + CAST(r_regionkey AS BIGINT) AS node_id, 'region' AS label, r_name AS name,
       CAST(NULL AS STRING) AS p1, CAST(NULL AS STRING) AS p2 FROM {region}
UNION ALL SELECT 2000000000 + CAST(n_nationkey AS BIGINT), 'nation', n_name, NULL, NULL FROM {nation}
UNION ALL SELECT 3000000000 + c_custkey, 'customer', c_name, c_mktsegment, NULL FROM {customer}
UNION ALL SELECT 4000000000 + s_suppkey, 'supplier', s_name, CAST(s_nationkey AS STRING), NULL FROM {supplier}
UNION ALL SELECT 5000000000 + p_partkey, 'part', p_name, p_brand, p_type FROM {part}
"""

EDGES_SQL = """
SELECT 2000000000 + CAST(n_nationkey AS BIGINT) AS src_id, 'in_region' AS rel,
       1000000000 + CAST(n_regionkey AS BIGINT) AS dst_id FROM {nation}
UNION ALL SELECT 3000000000 + c_custkey, 'based_in', 2000000000 + CAST(c_nationkey AS BIGINT) FROM {customer}
UNION ALL SELECT 4000000000 + s_suppkey, 'based_in', 2000000000 + CAST(s_nationkey AS BIGINT) FROM {supplier}
UNION ALL SELECT DISTINCT 4000000000 + l_suppkey, 'supplies', 5000000000 + l_partkey FROM {lineitem}
"""

PHRASINGS_SQL = """
SELECT * FROM (VALUES
 (0, 0, 'which segment buys <x>'), (0, 1, 'what market does <x> belong to'), (0, 2, 'segment of <x>'),
 (1, 0, 'what brand is <x>'), (1, 1, 'who makes <x>'), (1, 2, 'brand for <x>'),
 (2, 0, 'who is based in <x>'), (2, 1, 'list everyone in <x>'), (2, 2, 'members located in <x>'),
 (3, 0, 'tell me everything about <x>'), (3, 1, 'all details of <x>'), (3, 2, 'full record for <x>')
) AS t(template_id, phrasing, pattern)
"""

SAMPLES_SQL = """
SELECT template_id AS label, phrasing,
  replace(pattern, '<x>', CASE template_id WHEN 0 THEN 'tcust' WHEN 1 THEN 'tpart'
                                           WHEN 2 THEN 'tnation' ELSE 'tsupp' END) AS sentence
FROM {phrasings}
"""

QUESTIONS_SQL = """
SELECT question_id, gold_template, gold_name, replace(pattern, '<x>', gold_name) AS text FROM (
  SELECT c.c_custkey AS question_id, p.template_id AS gold_template, p.pattern,
    CASE WHEN c.c_custkey % 23 = 22 THEN 'Nobody' WHEN p.template_id = 0 THEN c.c_name
         WHEN p.template_id = 1 THEN pt.p_name WHEN p.template_id = 2 THEN n.n_name ELSE su.s_name END AS gold_name
  FROM {customer} c
  JOIN {phrasings} p ON p.template_id = c.c_custkey % 4
                  AND p.phrasing = CAST(floor((c.c_custkey % 12) / 4) AS INT)
  LEFT JOIN {part} pt ON pt.p_partkey = c.c_custkey
  LEFT JOIN {nation} n ON n.n_nationkey = c.c_custkey % 25
  LEFT JOIN {supplier} su ON su.s_suppkey = c.c_custkey % 10) AS q
"""

CARD_CLAUSES = (("p1", " nation '%s'."), ("p2", " type '%s'."))
#: Names per part in the list queries, small enough that most lists come out in several parts.
SHORT_PART = 5
TAG_ORDER = ("tsupp", "tpart", "tnation", "tcust")


def catalog() -> TemplateCatalog:
    return TemplateCatalog(
        [
            Template(0, "tcust segment", PROPERTY, "customer", "p1", None, 1),
            Template(1, "tpart brand", PROPERTY, "part", "p1", None, 1),
            Template(2, "based_in tnation", INBOUND, "nation", None, "based_in", 2),
            Template(3, "tsupp record", RECORD, "supplier", None, None, 1),
        ],
        {"supplier": CARD_CLAUSES, "part": CARD_CLAUSES},
    )


class StarSchema:
    """The derived tables over one folder of parquet files; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, *tables: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **{name: self.table(name) for name in tables}, **frames)

    @cached_property
    def flat_nodes(self) -> DataFrame:
        return self._sql(NODES_SQL, "region", "nation", "customer", "supplier", "part")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.flat_nodes.select("node_id", "label", "name", props_from_columns(["p1", "p2"]).alias("props"))

    @cached_property
    def edges(self) -> DataFrame:
        return self._sql(EDGES_SQL, "nation", "customer", "supplier", "lineitem")

    @cached_property
    def phrasings(self) -> DataFrame:
        return self.spark.sql(PHRASINGS_SQL)

    @cached_property
    def samples(self) -> DataFrame:
        return self._sql(SAMPLES_SQL, phrasings=self.phrasings)

    @cached_property
    def gold_questions(self) -> DataFrame:
        return self._sql(QUESTIONS_SQL, "customer", "part", "nation", "supplier", phrasings=self.phrasings)

    @cached_property
    def questions(self) -> DataFrame:
        return self.gold_questions.select("question_id", "text")

    @cached_property
    def dictionary(self) -> DataFrame:
        names = (
            ("nation", "n_name", "tnation"),
            ("customer", "c_name", "tcust"),
            ("supplier", "s_name", "tsupp"),
            ("part", "p_name", "tpart"),
        )
        return union_dictionaries([
            parse_dictionary(self.table(table).select(F.col(column).alias("value")).distinct(), tag, order)
            for order, (table, column, tag) in enumerate(names)
        ])

    @cached_property
    def vocabulary(self) -> DataFrame:
        words = self.samples.select(F.explode(tx.tokenize(F.col("sentence"))).alias("word")).distinct()
        return words.select((F.row_number().over(Window.orderBy("word")) - 1).alias("idx"), "word")

    @cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(self.dictionary, self.vocabulary)

    @cached_property
    def graph(self) -> Graph:
        return Graph(self.nodes, self.edges)

    @cached_property
    def engine(self) -> QuestionEngine:
        words = vocabulary_words(self.vocabulary)
        classifier = fit_naive_bayes(labeled_points(self.samples, words, self.lexicon), words)
        return QuestionEngine(self.graph, catalog(), self.lexicon, classifier)

    # --- text classification on the document table ---

    @cached_property
    def document_words(self) -> DataFrame:
        """``doc_id, lang, words``: the tokens of every document."""
        return self.table("documents").select("doc_id", "lang", tx.tokenize(F.col("text")).alias("words"))

    @cached_property
    def stored_words(self) -> DataFrame:
        """:attr:`document_words` written once, for all that pass over them several times."""
        return stored(self.document_words, "document-words")

    @cached_property
    def document_vocabulary(self) -> DataFrame:
        """``word, idx`` of every word of the documents, numbered in their order."""
        words = self.stored_words.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
        numbered = with_position(words, ["word"])
        return stored(numbered.select(F.col("idx").cast("int").alias("idx"), "word"), "document-vocabulary")

    @cached_property
    def document_hits(self) -> DataFrame:
        """``doc_id, lang, idx``: the distinct words of every document, by number."""
        return stored(feature_hits(self.stored_words, self.document_vocabulary, "doc_id", carry=["lang"]), "document-hits")

    @cached_property
    def language_points(self) -> DataFrame:
        """``doc_id, label, weight, idxs``: the language of every document and the numbers of all of its words."""
        labelled = self.table("documents").select("doc_id", F.col("lang").alias("label"))
        return stored(sparse_points(self.document_hits.select("doc_id", "idx"), labelled, "doc_id"), "language-points")
