"""The shuffle paths of the graph: stored by join keys, and with names filtered by the ids that were reached."""

import uuid

import pytest
from pyspark.sql import functions as F

from graphask.operators import graph as gr
from graphask.operators.graph import Graph
from graphask.plans import cut_lineage, id_filter
from graphask.plans.id_filter import key_bitmap, possible
from graphask.sources import read_clustered_graph, write_clustered_graph


@pytest.fixture
def no_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(gr, "broadcast_if_bounded", lambda df, *_, **__: (df, False))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def tables(spark):
    nodes = spark.range(2_000).select(
        F.col("id").alias("node_id"),
        F.when(F.col("id") < 100, "target").otherwise("source").alias("label"),
        F.concat(F.lit("n"), F.col("id")).alias("name"),
        F.create_map(F.lit("p"), F.col("id").cast("string")).alias("props"),
    )
    edges = spark.range(6_000).select((100 + F.col("id") % 1_900).alias("src_id"), F.lit("r").alias("rel"), (F.col("id") % 97).alias("dst_id"))
    asked = spark.range(5).select(F.lit("r").alias("rel"), F.lit("target").alias("label"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    return nodes, edges, asked


@pytest.fixture(scope="module")
def clustered(spark, tables, tmp_path_factory):
    name = f"graph_{uuid.uuid4().hex}"
    write_clustered_graph(*tables[:2], name, 4, str(tmp_path_factory.mktemp("clustered")))
    return read_clustered_graph(spark, name)


def _lines(plan, part):
    return [line for line in plan.splitlines() if part in line]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asks_meet_a_clustered_graph_without_shuffling_it(spark, tables, clustered, no_broadcasts):
    nodes, edges, names = clustered
    graph = Graph(nodes, edges, names=names)
    # Asks come as written rows, as in the engine: a literal label would leave the name alone as join key.
    asked = cut_lineage(tables[2])
    partners = (
        (nodes.where(F.col("label").isin("target")), asked.select("label", "name"), ["label", "name"]),
        (edges, cut_lineage(tables[1].select("rel", "dst_id").distinct()), ["rel", "dst_id"]),
        (names, cut_lineage(tables[1].select("src_id").distinct()), ["src_id"]),
    )
    for many, one, keys in partners:
        plan = _plan(gr._meet(many, one, keys, lambda: None, "unused"))
        scans = [i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line]
        assert scans, plan
        # Nothing between the join and the first scan, which is the graph's, is an exchange.
        lines = plan.splitlines()
        join = next(i for i, line in enumerate(lines) if "Join" in line)
        assert not any("Exchange" in line for line in lines[join : scans[0]])
    plain = gr.inbound_neighbors(asked, Graph(*tables[:2])).collect()
    assert sorted(map(tuple, gr.inbound_neighbors(asked, graph).collect())) == sorted(map(tuple, plain))


def test_names_are_filtered_by_what_was_reached(spark, tables, no_broadcasts, monkeypatch):
    passed = []

    def counted(rows, key, partners):
        kept = possible(rows, key, partners)
        passed.append((rows.count(), kept.count(), partners.select(key).distinct().count()))
        return kept

    monkeypatch.setattr(gr, "possible", counted)
    nodes, edges, asked = tables
    found = gr.inbound_neighbors(asked, Graph(nodes, edges))
    (before, after, reached), = passed
    assert (before, reached) == (2_000, after) and after < 500
    targets = {r["name"]: r["dst_id"] for r in asked.select("name", F.substring("name", 2, 9).cast("long").alias("dst_id")).collect()}
    want = sorted((n, s) for n, d in targets.items() for s, t in ((100 + i % 1_900, i % 97) for i in range(6_000)) if t == d)
    assert sorted((r["name"], r["src_id"]) for r in found.collect()) == want
    plan = _plan(found)
    assert _lines(plan, "bitmap_construct_agg") and _lines(plan, "BroadcastExchange")


def test_no_partner_is_lost_however_full_the_bitmap(spark, monkeypatch):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    partners = spark.range(0, 20_000, 7).withColumnRenamed("id", "k").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    want = set(range(0, 20_000, 7))
    for bits in (1 << 27, 1 << 16, 64):
        monkeypatch.setattr(id_filter, "BITS", bits)
        got = {r["k"] for r in possible(rows, "k", partners).collect()}
        assert want <= got
        if bits == 1 << 27:
            assert len(got) < len(want) + 20
        sizes = key_bitmap(partners, "k").agg(F.sum(F.octet_length("_bits")), F.count("*")).first()
        assert sizes[0] <= max(bits // 8, 4_096)
    assert possible(rows, "k", partners.limit(0)).count() == 0
