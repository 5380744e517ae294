import pytest
from pyspark.sql import functions as F

from aquaculture import tables
from graphask import schemas
from graphask.functions import answers as an
from graphask.operators import graph as gr
from graphask.sources import read_edges, read_nodes, write_edges, write_nodes
from graphask.operators.graph import Graph, name_lists, neighbor_lists, node_record, node_scan, property_lookup, route, tips
from graphask.plans.catalog import AQUACULTURE_TEMPLATES, aquaculture_catalog

IMAGE = (
    '<a target="_blank" rel="noopener noreferrer" href="http://img/1.jpg">'
    '<img src="http://img/1.jpg" title="点击查看大图"></a>'
)
EXPECTED = {
    0: ("草鱼", "鲩鱼"), 1: ("草鱼", "赤皮病"), 2: ("草鱼", IMAGE), 3: ("草鱼", "江"), 4: ("草鱼", "体长"),
    5: ("草鱼", "春季"), 6: ("草鱼", "草鱼塘"), 7: ("草鱼", "水草"), 8: ("水草", "纤维"), 9: ("赤皮病", "细菌"),
    10: ("赤皮病", "发红"), 11: ("赤皮病", "消毒"), 12: ("潜水泵", "抽水"), 13: ("草鱼塘", "潜水泵"),
    14: ("草鱼塘", "1.5米"), 15: ("草鱼塘", "2亩"), 16: ("草鱼鱼苗", "草鱼"), 17: ("草鱼鱼苗", "轮虫"),
    18: ("草鱼塘", "草鱼"), 19: ("赤皮病", "草鱼、鲤鱼"), 20: ("草鱼", "草鱼鱼苗"), 21: ("草鱼鱼苗", "草鱼受精卵"),
    22: ("水草", "草鱼"), 23: ("江", "草鱼、鲤鱼"), 24: ("潜水泵", "草鱼塘"),
    25: ("草鱼", "草鱼别名'鲩鱼'。它的特征是'体长'。养殖时一般在'草鱼塘'育苗。它的繁殖季节是'春季'。栖息于'江'。"
                 "用'水草'来饲养。养殖过程中，它可能感染'赤皮病'等疾病，您可以通过查询疾病的相关信息进行判断和防治。"
                 "<br>以下是它的图片：" + IMAGE),
}


@pytest.fixture(scope="module", params=[1_000_000, 1], ids=["plain", "salted"])
def graph(spark, request):
    """The same graph with no hot key and with every repeated key hot."""
    data = tables(spark)
    return Graph(data["nodes"], data["edges"], rows_per_task=request.param)


@pytest.fixture(scope="module")
def routed(spark, graph):
    asks = [(t, name) for t, (name, _) in EXPECTED.items()] + [(0, "鲤鱼"), (2, "鲤鱼"), (25, "鲤鱼"), (23, "水库"), (0, "无"), (0, ""), (77, "草鱼")]
    df = route(spark.createDataFrame(asks, "template_id int, slot_name string"), graph, aquaculture_catalog()).answers
    return {(r["template_id"], r["slot_name"]): r for r in df.collect()}


@pytest.mark.parametrize("template", AQUACULTURE_TEMPLATES, ids=lambda t: str(t.template_id))
def test_every_template(routed, template):
    name, answer = EXPECTED[template.template_id]
    assert routed[template.template_id, name]["raw_answer"] == answer


def test_missing_values(routed):
    assert routed[0, "鲤鱼"]["raw_answer"] == "\\N"
    assert routed[2, "鲤鱼"]["raw_answer"] is None
    assert routed[25, "鲤鱼"]["raw_answer"] == "鲤鱼它的特征是'有须'。"
    for ask in ((23, "水库"), (0, "无"), (0, "")):
        assert (routed[ask]["raw_answer"], routed[ask]["match_count"]) == (None, 0)
        assert routed[ask]["well_formed"]
    assert not routed[77, "草鱼"]["well_formed"]


def test_duplicate_name_answers_once(routed):
    assert routed[0, "草鱼"]["match_count"] == 2


def test_scan_and_tips(graph):
    assert sorted(r["name"] for r in node_scan(graph.nodes, "水产品").collect()) == ["草鱼", "草鱼", "鲤鱼"]
    assert [r["tips"] for r in tips(graph, "水产品").collect()] == ["当前可查询的水产品包括：草鱼、草鱼、鲤鱼"]


def test_property_and_record(spark, graph):
    asked = spark.createDataFrame([("水产品", "草鱼", "别名"), ("水产品", "草鱼", "没有"), ("水产品", "无", "别名")], "label string, name string, field string")
    got = {(r["name"], r["field"]): (r["value"], r["match_count"]) for r in property_lookup(asked, graph).collect()}
    assert got == {("草鱼", "别名"): ("鲩鱼", 2), ("草鱼", "没有"): (None, 2), ("无", "别名"): (None, 0)}
    names = asked.select("label", "name").distinct()
    records = {r["name"]: r for r in node_record(names, graph).collect()}
    assert records["草鱼"]["node_id"] == 1 and records["草鱼"]["props"]["特征"] == "体长"
    assert records["无"]["props"] is None


def test_long_lists_come_in_parts(spark):
    nodes = [(0, "hub", "h", {}), (-1, "hub", "small", {})] + [(i, "leaf", f"n{i:03d}", {}) for i in range(1, 301)]
    edges = [(i, "r", 0) for i in range(1, 301)] + [(5, "r", -1)]
    graph = Graph(spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame(edges, schemas.EDGES), 50)
    asked = spark.createDataFrame([("r", "hub", "h"), ("r", "hub", "small")], "rel string, label string, name string")
    rows = neighbor_lists(asked, graph, names_per_part=40).collect()
    parts = [r for r in rows if r["name"] == "h"]
    assert len(parts) == 8 and {r["n_parts"] for r in parts} == {8} and {r["n_names"] for r in parts} == {300}
    in_order = [n for r in sorted(parts, key=lambda r: r["part_no"]) for n in r["names"]]
    assert in_order == [f"n{i:03d}" for i in range(1, 301)]
    assert {len(r["names"]) for r in parts} == {40, 20}
    assert [(r["n_parts"], r["names"]) for r in rows if r["name"] == "small"] == [(1, ["n005"])]


@pytest.mark.parametrize("size", [1, 7, 30, 99, 100, 1000])
def test_parts_in_order_are_the_list(spark, monkeypatch, size):
    rows = spark.range(400).select((F.col("id") % 4).alias("g"), (F.col("id") % 50).cast("string").alias("name"))
    monkeypatch.setattr(gr, "broadcast_if_bounded", lambda df, size: (df, False))
    lists = sorted(name_lists(rows, ["g"], "name", names_per_part=size).lists.collect(), key=lambda r: (r["g"], r["part_no"]))
    for g in range(4):
        own = [r for r in lists if r["g"] == g]
        assert [r["part_no"] for r in own] == list(range(own[0]["n_parts"])) and {r["n_names"] for r in own} == {100}
        assert [n for r in own for n in r["names"]] == sorted(str(i % 50) for i in range(g, 400, 4))
        assert all(len(r["names"]) == size for r in own[:-1])


def test_parallel_edges_are_cut_into_parts(spark):
    rows = spark.range(500).select(F.lit(1).alias("g"), F.lit("same").alias("name"))
    lists = name_lists(rows, ["g"], "name", names_per_part=100).lists.collect()
    assert sorted((r["part_no"], len(r["names"])) for r in lists) == [(i, 100) for i in range(5)]


def test_parallel_edges_stay_a_bag(spark):
    nodes = [(1, "a", "s", {}), (2, "b", "t", {}), (3, "b", "t", {})]
    edges = [(1, "r", 2), (1, "r", 3)]
    graph = Graph(spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame(edges, schemas.EDGES))
    asked = spark.createDataFrame([("r", "b", "t")], "rel string, label string, name string")
    assert neighbor_lists(asked, graph).first()["names"] == ["s", "s"]


def test_statuses(spark):
    df = spark.createDataFrame(
        [("x", True, True), (None, True, True), ("", True, True), ("\\N", True, True), ("x", False, True), ("x", True, False)],
        "a string, s boolean, w boolean",
    )
    status = an.status_of(F.col("a"), F.col("s"), F.col("w"))
    got = [tuple(r) for r in df.select(status.alias("st"), an.answer_text(F.col("a"), status).alias("t")).collect()]
    assert [g[0] for g in got] == ["ok", "not_found", "not_found", "not_found", "no_slot", "error"]
    assert [g[1] for g in got] == ["x"] + ["抱歉,我没有找到你要的答案"] * 4 + ["系统繁忙，请稍后重试..."]


def test_few_asks_stream_past_the_graph(spark, graph, tmp_path):
    write_nodes(graph.nodes, str(tmp_path / "nodes"))
    write_edges(graph.edges, str(tmp_path / "edges"))
    stored = Graph(read_nodes(spark, str(tmp_path / "nodes")), read_edges(spark, str(tmp_path / "edges")))
    asked = spark.createDataFrame([("水产品", "草鱼", "别名")], "label string, name string, field string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = gr.matching_nodes(asked, stored, ["水产品"])
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    # The folder may be shortened in the plan, its filters are not.
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters: [isnotnull(label" in line)
    assert "水产品" in scan


def test_long_lists_are_written_once_a_step(spark, monkeypatch):
    """The rows of the lists are written as tables: reached, named, ranged. A checkpoint would compute them twice."""
    nodes = spark.createDataFrame(
        [(1, "nation", "n", {})] + [(i, "customer", f"c{i % 7}", {}) for i in range(10, 40)],
        "node_id long, label string, name string, props map<string,string>",
    )
    edges = spark.createDataFrame([(i, "based_in", 1) for i in range(10, 40)], "src_id long, rel string, dst_id long")
    written, checkpointed = [], []
    monkeypatch.setattr(gr, "stored", lambda df, name, stored=gr.stored: written.append(name) or stored(df, name))
    monkeypatch.setattr(gr, "cut_lineage", lambda df, cut=gr.cut_lineage: checkpointed.append(df.columns) or cut(df))
    asked = spark.createDataFrame([("based_in", "nation", "n")], "rel string, label string, name string")
    lists = gr.neighbor_lists(asked, gr.Graph(nodes, edges), 4)
    rows = sorted(lists.collect(), key=lambda row: row["part_no"])
    assert [name for row in rows for name in row["names"]] == sorted(f"c{i % 7}" for i in range(10, 40))
    assert [(row["part_no"], row["n_parts"], row["n_names"]) for row in rows] == [(i, 8, 30) for i in range(8)]
    assert written == ["reached", "names", "ranged-names"]
    assert not any("_row" in columns or {"src_id", "dst_id"} <= set(columns) for columns in checkpointed)
