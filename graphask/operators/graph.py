"""Lookups in a property graph: scan, property, record, inbound neighbours.

Requests are distinct keys, so every join has one unique side. The graph side
may repeat a key any number of times (a shared name, a hub node); its hot keys
are measured once per graph and salted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphask.functions import answers as an
from graphask.plans import HotKeys, broadcast_if_bounded, cut_lineage, find_hot_keys, measure, salted_join, stored
from graphask.plans.catalog import IMAGE, INBOUND, RECORD, TemplateCatalog
from graphask.plans.id_filter import possible
from graphask.plans.skew import ROWS_PER_TASK

NAMES_PER_PART = 50_000
_ASK = ["template_id", "slot_name"]


class Graph:
    """``nodes(node_id, label, name, props)`` and ``edges(src_id, rel, dst_id)``.

    ``names(src_id, source_name)`` are the names of all nodes once more where they are
    stored by id; otherwise they are read from the nodes. The hot keys are found on first use with one counting pass each and are
    then shared by every batch answered from this graph.
    """

    def __init__(
        self, nodes: DataFrame, edges: DataFrame, rows_per_task: int = ROWS_PER_TASK, names: DataFrame | None = None
    ) -> None:
        self.nodes = nodes
        self.edges = edges
        self.names = nodes.select(F.col("node_id").alias("src_id"), F.col("name").alias("source_name")) if names is None else names
        self._rows_per_task = rows_per_task

    def _hot(self, table: DataFrame, keys: list[str]) -> HotKeys:
        counts = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return find_hot_keys(counts, keys, rows_per_task=self._rows_per_task)

    @cached_property
    def hot_names(self) -> HotKeys:
        return self._hot(self.nodes, ["label", "name"])

    @cached_property
    def hot_targets(self) -> HotKeys:
        return self._hot(self.edges, ["rel", "dst_id"])

    @cached_property
    def hot_sources(self) -> HotKeys:
        return self._hot(self.edges, ["src_id"])


def node_scan(nodes: DataFrame, label: str) -> DataFrame:
    """The names of all nodes with a label."""
    return nodes.where(F.col("label") == label).select("name")


def _meet(many: DataFrame, asked: DataFrame, keys: list[str], hot: Callable[[], HotKeys], spread_by: str) -> DataFrame:
    """A graph table joined to distinct keys: it streams past them while they are few, else both are shuffled."""
    asked, bounded = broadcast_if_bounded(asked)
    if bounded:
        return many.join(asked, keys)
    return salted_join(many, asked, keys, hot(), spread_by)


def matching_nodes(requests: DataFrame, graph: Graph, labels: Sequence[str] | None = None) -> DataFrame:
    """Nodes asked for by ``label, name``; requests are distinct per label and name set.

    ``labels`` names all labels that are asked for, so that others are not read.
    """
    nodes = graph.nodes if labels is None else graph.nodes.where(F.col("label").isin(list(labels)))
    return _meet(nodes, requests, ["label", "name"], lambda: graph.hot_names, "node_id")


def property_lookup(requests: DataFrame, graph: Graph) -> DataFrame:
    """``label, name, field`` -> ``value`` and ``match_count``.

    Of several nodes with one name the smallest id answers. A request without a
    node keeps a null value and a count of 0.
    """
    keys = ["label", "name", "field"]
    found = (
        matching_nodes(requests.select(*keys), graph)
        .select(*keys, "node_id", F.try_element_at("props", "field").alias("value"))
        .groupBy(*keys)
        .agg(F.min(F.struct("node_id", "value")).alias("first"), F.count(F.lit(1)).alias("match_count"))
        .select(*keys, F.col("first.value").alias("value"), "match_count")
    )
    return requests.join(found, keys, "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))


def node_record(requests: DataFrame, graph: Graph) -> DataFrame:
    """``label, name`` -> ``node_id, props`` of the node with the smallest id, and ``match_count``."""
    keys = ["label", "name"]
    found = (
        matching_nodes(requests.select(*keys), graph)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("node_id", "props"), "node_id").alias("first"), F.count(F.lit(1)).alias("match_count"))
        .select(*keys, "first.node_id", "first.props", "match_count")
    )
    return requests.join(found, keys, "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))


def inbound_neighbors(
    requests: DataFrame,
    graph: Graph,
    carry: Sequence[str] = (),
    labels: Sequence[str] | None = None,
    rels: Sequence[str] | None = None,
) -> DataFrame:
    """``rel, label, name`` -> one row per edge that ends there.

    Returns ``rel, label, name, *carry, src_id, dst_id, source_name``. Bag
    semantics: a source with two edges, or with edges to two targets of the
    same name, comes out twice. ``labels`` and ``rels`` name all that are asked
    for, so that other partitions are not read. Few targets, and few sources,
    are sent to the graph; only many are met by a shuffle.
    """
    keys = ["rel", "label", "name", *carry]
    asked = requests.select(*keys)
    targets = cut_lineage(matching_nodes(asked, graph, labels).select(*keys, F.col("node_id").alias("dst_id")))
    edges = graph.edges if rels is None else graph.edges.where(F.col("rel").isin(list(rels)))
    # A checkpoint would compute the rows twice, once to count them and once to write them.
    reached = stored(
        _meet(edges.select("src_id", "rel", "dst_id"), targets, ["rel", "dst_id"], lambda: graph.hot_targets, "src_id"),
        "reached",
    )
    names = graph.names
    sources, few = broadcast_if_bounded(reached.select("src_id").distinct())
    if few:
        # The names of few sources are few rows too, node ids being distinct, but their bytes are measured as well.
        names = cut_lineage(names.join(sources, "src_id", "left_semi"))
        names, few = broadcast_if_bounded(names)
    if few:
        named = reached.join(names, "src_id")
    else:
        named = salted_join(reached, possible(names, "src_id", reached), ["src_id"], graph.hot_sources, "dst_id")
    return named.select(*keys, "src_id", "dst_id", "source_name")


class NameLists(NamedTuple):
    """``lists``: ``*by, part_no, n_parts, n_names, names``; ``long_groups``: ``*by, n_parts`` of
    the groups in several parts, or ``None`` when every list is one part."""

    lists: DataFrame
    long_groups: DataFrame | None


def name_lists(
    rows: DataFrame,
    by: Sequence[str],
    name: str,
    names_per_part: int = NAMES_PER_PART,
) -> NameLists:
    """Sorted name lists per group.

    A group over ``names_per_part`` comes out in several parts, which are slices of the
    whole sorted list: the parts in their order are the list, whatever their size.
    ``n_names`` counts the whole group. Only the rows of long groups are sorted by
    ranges, so no task holds a whole group, however many equal rows it has. The rows are
    written once, with a number that keeps equal rows apart.
    """
    by = list(by)
    rows = stored(rows.select(*by, F.col(name).alias("_name"), F.monotonically_increasing_id().alias("_row")), "names")
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    long_groups = counts.where(F.col("n") > names_per_part).select(
        *by,
        F.col("n").alias("n_long"),
        F.ceil(F.col("n") / names_per_part).cast("int").alias("n_parts"),
    )
    size = measure(long_groups)
    if size.rows == 0:
        marked = rows.withColumns({"n_long": F.lit(None).cast("long"), "n_parts": F.lit(1)})
    else:
        side, bounded = broadcast_if_bounded(long_groups, size=size)
        hot = None if bounded else find_hot_keys(counts, by)
        marked = salted_join(rows, side, by, hot, "_name", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    whole = marked.where(F.col("n_long").isNull()).withColumn("part_no", F.lit(0))
    if size.rows:
        whole = whole.drop("_row").unionByName(_numbered_parts(marked.where(F.col("n_long").isNotNull()), by, names_per_part))
    lists = (
        whole.groupBy(*by, "part_no", "n_parts", "n_long")
        .agg(F.sort_array(F.collect_list("_name")).alias("names"))
        .select(
            *by,
            "part_no",
            "n_parts",
            F.coalesce("n_long", F.size("names").cast("long")).alias("n_names"),
            "names",
        )
    )
    return NameLists(lists, long_groups.select(*by, "n_parts") if size.rows else None)


def _numbered_parts(rows: DataFrame, by: Sequence[str], names_per_part: int) -> DataFrame:
    """``part_no`` from the place of each row in its sorted group: ranges, their counts, offsets.

    The row number ``_row`` keeps equal rows apart, so they can be cut into ranges too.
    """
    order = [*by, "_name", "_row"]
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged-names")
    totals = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_in_range"))
    # A group has at most one row per range here.
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy("_name", "_row")
    place = F.col("_before") + F.row_number().over(inside) - 1
    return (
        ranged.join(offsets, [*by, "_range"])
        .withColumn("part_no", F.floor(place / names_per_part).cast("int"))
        .drop("_row", "_range", "_before")
    )


def neighbor_lists(requests: DataFrame, graph: Graph, names_per_part: int = NAMES_PER_PART) -> DataFrame:
    """The inbound names of each request as sorted lists."""
    reached = inbound_neighbors(requests, graph)
    return name_lists(reached, ["rel", "label", "name"], "source_name", names_per_part).lists


def tips(graph: Graph, label: str, names_per_part: int = NAMES_PER_PART) -> DataFrame:
    """What can be asked about: ``part_no, n_parts, tips``; only part 0 carries the prefix."""
    named = graph.nodes.where(F.col("label") == label).select("label", "name")
    lists = name_lists(named, ["label"], "name", names_per_part).lists
    joined = an.join_names(F.col("names"))
    return lists.select(
        "part_no", "n_parts", F.when(F.col("part_no") == 0, an.tips(F.col("names"))).otherwise(joined).alias("tips")
    )


class Routed(NamedTuple):
    """``answers``: ``template_id, slot_name, part_no, n_parts, match_count, raw_answer, well_formed``;
    ``long_asks``: ``template_id, slot_name, n_parts`` of the answers in several parts, or ``None``."""

    answers: DataFrame
    long_asks: DataFrame | None


def _asked(catalog: TemplateCatalog, field: str, direct: bool) -> list[str]:
    """The labels or relations that the templates of the catalog can ask for."""
    return sorted({getattr(t, field) for t in catalog.templates if (t.kind != INBOUND) == direct})


def route(asks: DataFrame, graph: Graph, catalog: TemplateCatalog, names_per_part: int = NAMES_PER_PART) -> Routed:
    """Answer distinct asks ``template_id, slot_name``; what is not found has a null ``raw_answer``.

    The kind of the template picks the lookup. Property, image and record share
    one join with the nodes. An empty name stands for a missing slot; a template
    outside the catalog is not well formed.
    """
    templates = F.broadcast(catalog.to_df(asks.sparkSession))
    routed = asks.select("template_id", "slot_name").join(templates, "template_id", "left").withColumn(
        "name", F.nullif("slot_name", F.lit(""))
    )

    direct = routed.where(F.col("kind") != INBOUND).select(*_ASK, "name", "kind", "label", "field")
    value = F.try_element_at("props", "field")
    record = F.lit(None).cast("string")
    for label, clauses in catalog.cards.items():
        record = F.when(F.col("label") == label, an.card(F.col("name"), F.col("props"), clauses)).otherwise(record)
    raw = (
        F.when(F.col("kind") == IMAGE, an.image(an.present(value)))
        .when(F.col("kind") == RECORD, record)
        .otherwise(value)
    )
    looked_up = (
        matching_nodes(direct, graph, _asked(catalog, "label", direct=True))
        .select(*_ASK, "node_id", raw.alias("raw"))
        .groupBy(*_ASK)
        .agg(F.min(F.struct("node_id", "raw")).alias("first"), F.count(F.lit(1)).alias("match_count"))
        .select(*_ASK, "match_count", F.col("first.raw").alias("raw_answer"))
    )
    plain = routed.where(F.col("kind").isNull() | (F.col("kind") != INBOUND))
    answered = plain.select(*_ASK, F.col("kind").isNotNull().alias("well_formed")).join(looked_up, _ASK, "left")

    inbound = routed.where(F.col("kind") == INBOUND).select(*_ASK, "name", "rel", "label")
    reached = inbound_neighbors(
        inbound, graph, _ASK, _asked(catalog, "label", direct=False), _asked(catalog, "rel", direct=False)
    )
    lists, long_asks = name_lists(reached, _ASK, "source_name", names_per_part)
    listed = lists.select(
        *_ASK,
        "part_no",
        "n_parts",
        F.col("n_names").alias("match_count"),
        an.join_names(F.col("names")).alias("raw_answer"),
        F.lit(True).alias("well_formed"),
    )
    # An anti join on the keys alone: the parts of a long list never meet their ask in one task.
    unlisted = inbound.select(*_ASK, F.lit(True).alias("well_formed")).join(
        lists.select(*_ASK).distinct(), _ASK, "left_anti"
    )
    single = answered.unionByName(unlisted, allowMissingColumns=True).select(
        *_ASK,
        F.lit(0).alias("part_no"),
        F.lit(1).alias("n_parts"),
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        "raw_answer",
        "well_formed",
    )
    return Routed(single.unionByName(listed), long_asks)
