"""Every operator run over the star-schema tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphask.examples.star_schema import CARD_CLAUSES, SHORT_PART, TAG_ORDER, StarSchema, catalog
from graphask.functions import answers as an
from graphask.functions import text as tx
from graphask.operators import classifiers as cl
from graphask.operators import dictionary as di
from graphask.operators import graph as gr
from graphask.operators import naive_bayes as nb
from graphask.operators import trees as tr
from graphask.operators.conversion import ConversionTable, convert_phrases
from graphask.operators.features import feature_hits
from graphask.operators.tagging import explode_terms, highest_tag, last_mentions, tag_entities
from graphask.plans import cut_lineage, scratch_dir, stored
from graphask.sources import (
    label_sections,
    node_scan_source,
    parse_dictionary,
    parse_templates,
    parse_vocabulary,
    read_answers,
    read_clustered_graph,
    read_edges,
    read_nodes,
    read_questions,
    stream_questions,
    union_dictionaries,
    write_answers,
    write_clustered_graph,
    write_edges,
    write_nodes,
)
from graphask.streaming import DictionaryVersions, answer_stream, update_dictionary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_LABELS = ("region", "nation", "customer", "supplier", "part")
_RELATIONS = ("in_region", "based_in", "supplies")
_BOM = "﻿"


def query(function: Callable[[StarSchema], DataFrame]) -> Callable[[StarSchema], DataFrame]:
    """Register ``function`` under its own name."""
    QUERIES[function.__name__] = lambda spark, sf_dir: function(StarSchema(spark, sf_dir))
    return function


# --- sources and sinks ---


@query
def src_dictionary(star: StarSchema) -> DataFrame:
    lines = star.table("customer").select(F.concat("c_name", F.lit(" ")).alias("value"))
    return parse_dictionary(lines, "tcust", 1)


@query
def src_dictionary_all(star: StarSchema) -> DataFrame:
    return star.dictionary


@query
def src_vocabulary(star: StarSchema) -> DataFrame:
    mark = F.when(F.col("p_brand") == "Brand#1", F.lit(_BOM)).otherwise(F.lit(""))
    lines = star.table("part").select(F.concat(mark, F.col("p_partkey"), F.lit(":"), F.col("p_name")).alias("value"))
    return parse_vocabulary(lines)


@query
def src_templates(star: StarSchema) -> DataFrame:
    lines = star.table("supplier").select(
        F.concat(F.col("s_suppkey"), F.lit(":tsupp "), F.col("s_name")).alias("value")
    )
    return parse_templates(lines)


@query
def src_samples(star: StarSchema) -> DataFrame:
    """Every document as a sectioned file of two sections, read in pieces of four lines."""
    lines = F.split("text", "\n")
    first, second = (
        F.array(F.concat(F.lit("===== "), label.cast("string"), F.lit(" section =====")))
        for label in (F.col("doc_id"), -1 - F.col("doc_id"))
    )
    sectioned = F.concat(first, F.slice(lines, 1, 5), second, F.slice(lines, F.lit(6), F.size(lines)))
    numbered = star.table("documents").select(
        F.col("doc_id").alias("file"), F.posexplode(sectioned).alias("seq", "value")
    )
    return label_sections(numbered.withColumn("split", F.floor(F.col("seq") / 4)))


@query
def src_nodes(star: StarSchema) -> DataFrame:
    """Written by label and read back label by label."""
    path = scratch_dir(star.spark, "nodes")
    write_nodes(star.nodes, path)
    stored = read_nodes(star.spark, path)
    parts = [node_scan_source(stored, label) for label in _LABELS]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes.select("node_id", "label", "name", F.col("props")["p1"].alias("p1"), F.col("props")["p2"].alias("p2"))


@query
def src_edges(star: StarSchema) -> DataFrame:
    """Written by relation and read back relation by relation."""
    path = scratch_dir(star.spark, "edges")
    write_edges(star.edges, path)
    edges = read_edges(star.spark, path, _RELATIONS[0])
    for rel in _RELATIONS[1:]:
        edges = edges.unionByName(read_edges(star.spark, path, rel))
    return edges


@query
def src_questions(star: StarSchema) -> DataFrame:
    path = scratch_dir(star.spark, "questions")
    star.questions.write.json(path)
    return read_questions(star.spark, path, "json")


@query
def src_questions_stream(star: StarSchema) -> DataFrame:
    base = scratch_dir(star.spark, "question-stream")
    star.questions.repartition(6).write.parquet(f"{base}/in")
    arriving = stream_questions(star.spark, f"{base}/in", max_files_per_trigger=2)
    writer = arriving.writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
    writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return star.spark.read.parquet(f"{base}/out")


@query
def sink_answers(star: StarSchema) -> DataFrame:
    path = scratch_dir(star.spark, "answers")
    write_answers(star.engine.answer(star.questions), path)
    return read_answers(star.spark, path)


# --- dictionary ---


def _part_entries(star: StarSchema, tag: str) -> DataFrame:
    return star.table("part").select(
        F.col("p_name").alias("word"),
        F.col(tag).alias("tag"),
        F.col("p_size").alias("freq"),
        F.col("p_partkey").alias("load_order"),
    )


def _attribute() -> Column:
    """Well-formed, bare and malformed attribute strings, by part type."""
    return (
        F.when(F.col("p_type") == "PROMO", F.col("p_brand"))
        .when(F.col("p_type") == "LARGE", F.concat(F.col("p_brand"), F.lit(" "), F.col("p_size"), F.lit(" x")))
        .otherwise(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_size")))
    )


@query
def dict_parse_attr(star: StarSchema) -> DataFrame:
    parsed = star.table("part").withColumn("parsed", di.parse_attribute(_attribute()))
    return parsed.select("p_partkey", "parsed.tag", "parsed.freq", F.col("parsed.valid").cast("int").alias("valid"))


@query
def dict_conflict(star: StarSchema) -> DataFrame:
    return di.dictionary_conflicts(_part_entries(star, "p_type")).withColumn("tags", F.array_join("tags", ","))


@query
def dict_add(star: StarSchema) -> DataFrame:
    existing = star.dictionary.where(F.col("tag") != "tpart")
    suppliers = parse_dictionary(star.table("supplier").select(F.col("s_name").alias("value")), "again", 9)
    return di.add_words(existing, union_dictionaries([_part_entries(star, "p_brand"), suppliers]))


def _updates(star: StarSchema) -> tuple[DataFrame, DataFrame]:
    parts = star.table("part").select(
        F.col("p_name").alias("word"), _attribute().alias("attr"), F.col("p_partkey").alias("load_order")
    )
    customers = star.table("customer").select(
        F.col("c_name").alias("word"),
        F.concat(F.col("c_mktsegment"), F.lit(" 7")).alias("attr"),
        F.col("c_custkey").alias("load_order"),
    )
    return parts, customers


@query
def dict_upsert(star: StarSchema) -> DataFrame:
    parts, customers = _updates(star)
    return di.upsert_words(_part_entries(star, "p_type"), parts.unionByName(customers))


@query
def dict_stream(star: StarSchema) -> DataFrame:
    """The dictionary after each of two batches of updates that arrive on a stream."""
    base = scratch_dir(star.spark, "dictionary-stream")
    versions = DictionaryVersions.create(_part_entries(star, "p_type"), f"{base}/versions")
    for arriving in _updates(star):
        arriving.write.mode("append").parquet(f"{base}/in")
        updates = star.spark.readStream.schema(arriving.schema).parquet(f"{base}/in")
        update_dictionary(updates, versions, f"{base}/state", available_now=True).awaitTermination()
    first, second = (versions.read(v).withColumn("version", F.lit(v)) for v in (1, versions.latest()))
    return first.unionByName(second)


# --- text ---


@query
def txt_normalize(star: StarSchema) -> DataFrame:
    documents = star.table("documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text"
    )
    turns = star.table("conversations").select(
        F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn", "text"
    )
    return documents.unionByName(turns).select(
        "kind", "id", "turn", F.md5(tx.normalize(F.col("text"))).alias("digest")
    )


@query
def txt_convert_phrases(star: StarSchema) -> DataFrame:
    """Suppliers and nations in the questions, written by their numbers and regions."""
    suppliers = star.table("supplier").select(
        F.col("s_name").alias("source"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("target"), F.col("s_suppkey").cast("long").alias("load_order")
    )
    nations = star.table("nation").join(star.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("source"),
        F.concat_ws(" of ", "n_name", "r_name").alias("target"),
        F.col("n_nationkey").cast("long").alias("load_order"),
    )
    return convert_phrases(star.questions, ConversionTable(suppliers.unionByName(nations)))


@query
def txt_tokenize(star: StarSchema) -> DataFrame:
    return star.document_words.select(
        "doc_id",
        F.size("words").alias("n_tokens"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.md5(F.array_join("words", " ")).alias("digest"),
    )


def _tagged(star: StarSchema) -> DataFrame:
    return tag_entities(star.questions, star.lexicon)


@query
def txt_tag_entities(star: StarSchema) -> DataFrame:
    return explode_terms(_tagged(star)).where(F.col("tag").isNotNull())


@query
def txt_tag_precedence(star: StarSchema) -> DataFrame:
    return _tagged(star).select("question_id", highest_tag(F.col("terms"), TAG_ORDER).alias("first_tag"))


@query
def txt_abstract(star: StarSchema) -> DataFrame:
    return _tagged(star).select("question_id", tx.abstract_text(F.col("terms")).alias("abstract"))


@query
def txt_mention_map(star: StarSchema) -> DataFrame:
    return last_mentions(explode_terms(_tagged(star)))


def _filled(star: StarSchema) -> DataFrame:
    gold = star.gold_questions.select("question_id", F.col("gold_template").alias("template_id"))
    patterns = F.broadcast(catalog().to_df(star.spark).select("template_id", "pattern"))
    mentions = _tagged(star).select("question_id", tx.mention_map(F.col("terms")).alias("mentions"))
    return (
        mentions.join(gold, "question_id")
        .join(patterns, "template_id")
        .select("question_id", tx.fill_template(F.col("pattern"), F.col("mentions")).alias("filled"))
    )


@query
def txt_fill_template(star: StarSchema) -> DataFrame:
    return _filled(star).select("question_id", F.array_join("filled", " ").alias("filled"))


@query
def txt_split_slots(star: StarSchema) -> DataFrame:
    return _filled(star).select(
        "question_id", tx.slot(F.col("filled"), 1).alias("slot1"), tx.slot(F.col("filled"), 2).alias("slot2")
    )


@query
def txt_analyze(star: StarSchema) -> DataFrame:
    return star.engine.analyze(star.questions).select("question_id", "template_id", "slot1", "slot2", "n_hits")


# --- features and classification ---


def _labels(star: StarSchema) -> DataFrame:
    return star.table("labels").select("doc_id", F.col("quality").alias("label"))


def _language_scores(star: StarSchema) -> tuple[nb.NaiveBayesTable, DataFrame]:
    """Table-form naive Bayes over the whole vocabulary, and ``doc_id, scores`` of every document."""
    hits = star.document_hits
    train, _ = cl.split_by_key(hits.withColumnRenamed("lang", "label"), "doc_id")
    texts = star.table("documents").select("doc_id", F.col("lang").alias("label"))
    model = nb.fit_table(train, cl.split_by_key(texts, "doc_id")[0], star.document_vocabulary)
    return model, nb.score_table(model, texts, hits, "doc_id")


@query
def feat_binary_bow(star: StarSchema) -> DataFrame:
    hits = feature_hits(star.stored_words, star.document_vocabulary, "doc_id")
    return hits.select("doc_id", "idx")


@query
def feat_labeled_points(star: StarSchema) -> DataFrame:
    """Every word of every labelled document, through one sparse row per document."""
    labelled = _labels(star)
    hits = feature_hits(star.stored_words, star.document_vocabulary, "doc_id").join(labelled.select("doc_id"), "doc_id")
    points = tr.sparse_points(hits, labelled, "doc_id")
    return points.select("doc_id", "label", F.explode("idxs").alias("idx"), F.col("weight").alias("value"))


@query
def feat_vectors(star: StarSchema) -> DataFrame:
    """Dense vectors and their positive part, through vectors and back to arrays."""
    dense = F.transform("embedding", lambda v: v.cast("double"))
    positive = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    vectors = star.table("embeddings").select(
        "vec_id", array_to_vector(dense).alias("dense"), array_to_vector(positive).alias("positive")
    )
    arrays = vectors.select("vec_id", vector_to_array("dense").alias("d"), vector_to_array("positive").alias("p"))
    dot = F.aggregate(F.zip_with("d", "p", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return arrays.select(
        "vec_id",
        F.size("d").alias("n_dims"),
        F.size(F.filter("p", lambda v: v > 0)).alias("n_positive"),
        F.round(dot, 6).alias("dot"),
    )


@query
def ml_split(star: StarSchema) -> DataFrame:
    part = F.when(cl.in_training(F.col("doc_id")), F.lit("train")).otherwise(F.lit("test"))
    return star.table("documents").select("doc_id", part.alias("part"))


@query
def ml_naive_bayes_fit(star: StarSchema) -> DataFrame:
    train, _ = cl.split_by_key(star.stored_words.withColumnRenamed("lang", "label"), "doc_id")
    hits = feature_hits(train, star.document_vocabulary, "doc_id", carry=["label"])
    model = nb.fit_table(hits, train.select("doc_id", "label"), star.document_vocabulary)
    return model.to_long().select(
        "label",
        "idx",
        F.round("log_theta", 6).alias("log_theta"),
        F.round("log_prior", 6).alias("log_prior"),
    )


@query
def ml_naive_bayes_counts(star: StarSchema) -> DataFrame:
    """Count features, labels 1 and 2, trained on labelled documents, every document scored."""
    # Written once: the model is fitted on the counts and scores them.
    counts = stored(feature_hits(star.stored_words, star.document_vocabulary, "doc_id", binary=False), "document-counts")
    labels = star.table("labels").select("doc_id", (F.col("quality") + 1).alias("label"))
    model = nb.fit_table(counts.join(labels, "doc_id"), labels, star.document_vocabulary, value="value")
    scores = nb.score_table(model, star.table("documents"), counts, "doc_id", value="value")
    return scores.select(
        "doc_id",
        nb.argmax_label(model, F.col("scores")).alias("prediction"),
        F.round(F.get(nb.probabilities(F.col("scores")), F.lit(0)), 6).alias("p_first"),
    )


@query
def ml_predict(star: StarSchema) -> DataFrame:
    model, scores = _language_scores(star)
    return scores.select("doc_id", nb.argmax_label(model, F.col("scores")).alias("prediction"))


@query
def ml_predict_proba(star: StarSchema) -> DataFrame:
    model, scores = _language_scores(star)
    labels = F.array(*[F.lit(label) for label in model.labels])
    return scores.select("doc_id", F.posexplode(nb.probabilities(F.col("scores"))).alias("k", "p")).select(
        "doc_id", F.get(labels, "k").alias("label"), F.round("p", 6).alias("probability")
    )


@query
def ml_accuracy(star: StarSchema) -> DataFrame:
    model, scores = _language_scores(star)
    predicted = scores.select("doc_id", nb.argmax_label(model, F.col("scores")).alias("prediction"))
    _, test = cl.split_by_key(star.table("documents").select("doc_id", F.col("lang").alias("label")), "doc_id")
    return cl.accuracy(test.join(predicted, "doc_id")).withColumn("accuracy", F.round("accuracy", 6))


def _language_test(star: StarSchema, model: tr.DecisionTree | tr.BoostedTrees) -> DataFrame:
    _, test = cl.split_by_key(star.language_points, "doc_id")
    measured = cl.accuracy(model.predict(test))
    return measured.select(F.lit(model.name).alias("model"), "n_test", F.round("accuracy", 6).alias("accuracy"))


def _language_tree(star: StarSchema) -> tr.DecisionTree:
    return tr.fit_tree(cl.split_by_key(star.language_points, "doc_id")[0])


def _language_boosted(star: StarSchema) -> tr.BoostedTrees:
    return tr.fit_boosted(cl.split_by_key(star.language_points, "doc_id")[0])


@query
def ml_decision_tree_nodes(star: StarSchema) -> DataFrame:
    """Every node of the tree: the word it asks for, or the language it ends in."""
    return _language_tree(star).nodes.select("node", "depth", "idx", "prediction")


@query
def ml_decision_tree_fit(star: StarSchema) -> DataFrame:
    return _language_test(star, _language_tree(star))


@query
def ml_boosted_fit(star: StarSchema) -> DataFrame:
    return _language_test(star, _language_boosted(star))


@query
def ml_select_model(star: StarSchema) -> DataFrame:
    """The model of the three that is right most often on the held-out part; the first of equally good ones."""
    bayes = ml_accuracy(star).select(F.lit("naive_bayes").alias("model"), "n_test", "accuracy")
    trained = [bayes, _language_test(star, _language_tree(star)), _language_test(star, _language_boosted(star))]
    ranked = trained[0].withColumn("place", F.lit(0))
    for place, table in enumerate(trained[1:], 1):
        ranked = ranked.unionByName(table.withColumn("place", F.lit(place)))
    best = F.max_by(F.struct("model", "n_test", "accuracy"), F.struct("accuracy", -F.col("place"))).alias("best")
    return ranked.agg(best).select("best.*")


@query
def ml_template_lookup(star: StarSchema) -> DataFrame:
    analyzed = star.engine.analyze(star.questions).select("question_id", "template_id")
    return cl.lookup_templates(analyzed, catalog().to_df(star.spark), "template_id").select(
        "question_id", "template_id", "pattern"
    )


# --- graph ---


@query
def graph_node_scan(star: StarSchema) -> DataFrame:
    names = [gr.node_scan(star.nodes, label).withColumn("label", F.lit(label)) for label in _LABELS]
    scanned = names[0]
    for part in names[1:]:
        scanned = scanned.unionByName(part)
    return scanned


def _asked_names(star: StarSchema) -> DataFrame:
    labels = F.broadcast(
        catalog().to_df(star.spark).select(F.col("template_id").alias("gold_template"), "label")
    )
    return star.gold_questions.join(labels, "gold_template").select("label", F.col("gold_name").alias("name")).distinct()


@query
def graph_property_lookup(star: StarSchema) -> DataFrame:
    return gr.property_lookup(_asked_names(star).withColumn("field", F.lit("p1")), star.graph)


@query
def graph_node_record(star: StarSchema) -> DataFrame:
    record = gr.node_record(_asked_names(star), star.graph)
    return record.select(
        "label",
        "name",
        "node_id",
        F.col("props")["p1"].alias("p1"),
        F.col("props")["p2"].alias("p2"),
        "match_count",
    )


def _targets(star: StarSchema) -> DataFrame:
    """Every name that edges can end at."""
    relations = {"region": "in_region", "nation": "based_in", "part": "supplies"}
    rel = F.lit(None).cast("string")
    for label, name in relations.items():
        rel = F.when(F.col("label") == label, F.lit(name)).otherwise(rel)
    named = star.nodes.where(F.col("label").isin(*relations)).select(rel.alias("rel"), "label", "name")
    return named.distinct()


@query
def graph_inbound_neighbors(star: StarSchema) -> DataFrame:
    return gr.inbound_neighbors(_targets(star), star.graph).drop("dst_id")


@query
def graph_clustered(star: StarSchema) -> DataFrame:
    """The same neighbours from a graph that is stored by its join keys."""
    path = scratch_dir(star.spark, "clustered-graph")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(star.spark.conf.get("spark.sql.shuffle.partitions"))
    write_clustered_graph(star.nodes, star.edges, name, buckets, path)
    nodes, edges, names = read_clustered_graph(star.spark, name)
    return gr.inbound_neighbors(_targets(star), gr.Graph(nodes, edges, names=names)).drop("dst_id")


@query
def graph_neighbor_lists(star: StarSchema) -> DataFrame:
    lists = gr.neighbor_lists(_targets(star), star.graph, SHORT_PART)
    return lists.withColumn("names", F.array_join("names", ","))


@query
def graph_route(star: StarSchema) -> DataFrame:
    asks = star.gold_questions.select(
        F.col("gold_template").alias("template_id"), F.col("gold_name").alias("slot_name")
    ).distinct()
    answers = gr.route(asks, star.graph, catalog(), SHORT_PART).answers
    return answers.withColumn("well_formed", F.col("well_formed").cast("int"))


# --- answers ---


@query
def ans_join_names(star: StarSchema) -> DataFrame:
    """The sources of every target; a target without edges has no answer."""
    keys = ["rel", "label", "name"]
    targets = _targets(star)
    lists = gr.neighbor_lists(targets, star.graph, SHORT_PART).select(*keys, "part_no", an.join_names(F.col("names")).alias("answer"))
    # Written once: the lists are returned, and their keys tell the targets without any.
    lists = stored(lists, "name-lists")
    without = targets.join(lists.select(*keys).distinct(), keys, "left_anti")
    return lists.unionByName(without, allowMissingColumns=True).select("rel", "name", "part_no", "answer")


@query
def ans_tips(star: StarSchema) -> DataFrame:
    return gr.tips(star.graph, "customer", SHORT_PART)


@query
def ans_image(star: StarSchema) -> DataFrame:
    url = an.present(F.when(F.col("html").contains("<img"), F.col("url")))
    return star.table("pages").select("page_id", an.image(url).alias("answer"))


@query
def ans_card(star: StarSchema) -> DataFrame:
    return star.nodes.select("node_id", an.card(F.col("name"), F.col("props"), CARD_CLAUSES).alias("answer"))


def _checked(answers: DataFrame, key: str) -> DataFrame:
    status = an.status_of(F.col("raw"), F.col("has_slot"), F.col("well_formed"))
    checked = answers.withColumn("status", status)
    return checked.select(key, an.answer_text(F.col("raw"), F.col("status")).alias("answer"), "status")


@query
def ans_not_found(star: StarSchema) -> DataFrame:
    """Null, empty and null-marker answers among the node properties."""
    raw = (
        F.when(F.col("label") == "region", F.lit(an.NULL_MARKER))
        .when(F.col("label") == "nation", F.lit(""))
        .otherwise(F.col("props")["p2"])
    )
    found = star.nodes.select(
        "node_id", raw.alias("raw"), F.lit(True).alias("has_slot"), F.lit(True).alias("well_formed")
    )
    return _checked(found, "node_id")


@query
def ans_error(star: StarSchema) -> DataFrame:
    """A template that is not in the catalog gives the busy text instead of a failure."""
    known = F.broadcast(
        catalog().to_df(star.spark).select(F.col("template_id").alias("asked"), F.lit(True).alias("known"))
    )
    asked = star.gold_questions.withColumn(
        "asked", F.when(F.col("gold_name") == "Nobody", F.lit(99)).otherwise(F.col("gold_template"))
    )
    found = asked.join(known, "asked", "left").select(
        "question_id",
        F.col("gold_name").alias("raw"),
        F.lit(True).alias("has_slot"),
        F.coalesce("known", F.lit(False)).alias("well_formed"),
    )
    return _checked(found, "question_id")


@query
def qa_batch(star: StarSchema) -> DataFrame:
    return star.engine.answer(star.questions)


@query
def qa_normalized_questions(star: StarSchema) -> DataFrame:
    """What each question asks; with the answers below, linear in questions and in asks."""
    return star.engine.answer_normalized(star.questions)[0]


@query
def qa_normalized_answers(star: StarSchema) -> DataFrame:
    """One row per distinct ask and part."""
    return star.engine.answer_normalized(star.questions)[1]


@query
def qa_stream(star: StarSchema) -> DataFrame:
    base = scratch_dir(star.spark, "answer-stream")
    star.questions.repartition(3).write.parquet(f"{base}/in")
    arriving = stream_questions(star.spark, f"{base}/in", max_files_per_trigger=1)
    answer_stream(arriving, star.engine, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return read_answers(star.spark, f"{base}/out").drop("batch_id")
