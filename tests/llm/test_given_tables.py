"""The registered queries on the given tables: against their SQL, planted cases, or held-out labels."""

from pathlib import Path

import pytest

from graphask.llm.queries import ORACLES, QUERIES
from graphask.plans.lineage import use_local_scratch

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def _duck(sf):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{sf}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    use_local_scratch(spark)
    result = QUERIES[name](spark, f"{DATA}/sf0.001")
    relation = _duck("sf0.001").execute(ORACLES[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(result.columns)
    got = sorted((tuple(r) for r in result.select(*columns).collect()), key=repr)
    assert got == sorted(relation.fetchall(), key=repr)


def _plain(text):
    return [w.strip(".,!?;:#*$%&|").lower() for w in text.split()]


def test_whole_items_are_found(spark):
    duck = _duck("sf0.01")
    items = [" ".join(_plain(t)) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    planted = {i for i, t in docs if any(f" {item} " in f" {' '.join(_plain(t))} " for item in items)}
    found = {r["doc_id"] for r in QUERIES["op3_decontamination"](spark, f"{DATA}/sf0.01").collect()}
    assert planted and planted <= found and len(found - planted) <= 0.05 * len(planted)


def test_notice_lines_are_found(spark):
    lines = ("Licensed under", "Released under", "is licensed under")
    docs = _duck("sf0.01").execute("SELECT doc_id, text FROM documents").fetchall()
    planted = {i for i, t in docs if any(line in t for line in lines)}
    found = {r["doc_id"] for r in QUERIES["op6_license_scan"](spark, f"{DATA}/sf0.01").collect()}
    assert found == planted


def test_held_out_grades(spark):
    duck = _duck("sf0.01")
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = [r for r in QUERIES["op4_ordinal_quality"](spark, f"{DATA}/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50 and sum(r["kept"] == bool(labels[r["doc_id"]]) for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["p_above_1"] <= r["p_above_0"] <= 1 for r in rows)


def test_held_out_toxicity(spark):
    labels = {i: (t, q) for i, t, q in _duck("sf0.1").execute("SELECT doc_id, toxic, quality FROM labels").fetchall()}
    rows = [r for r in QUERIES["op9_toxicity"](spark, f"{DATA}/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    # Junk texts may have lost the words that made them toxic.
    caught = [r["predicted"] for r in rows if labels[r["doc_id"]] == (1, 1)]
    false = [r["predicted"] for r in rows if labels[r["doc_id"]][0] == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(false) <= 0.02 * len(false)


def test_rules_follow_the_labels(spark):
    use_local_scratch(spark)
    labels = dict(_duck("sf0.01").execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = [r for r in QUERIES["op1_quality_rules"](spark, f"{DATA}/sf0.01").collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(r["kept"] == bool(labels[r["doc_id"]]) for r in rows) >= 0.95 * len(rows)
