"""Registered queries next to their SQL on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import oracle_sql, queries
from graphask.examples.star_schema import TABLES

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
CHECKED = (
    "src_samples",
    "src_vocabulary",
    "dict_add",
    "dict_upsert",
    "dict_conflict",
    "txt_tokenize",
    "txt_tag_entities",
    "feat_binary_bow",
    "ml_naive_bayes_counts",
    "ml_predict",
    "graph_inbound_neighbors",
    "graph_route",
    "graph_neighbor_lists",
    "ans_tips",
    "src_edges",
    "qa_normalized_answers",
)


@pytest.fixture(scope="module")
def duck():
    if not SF_DIR.exists():
        pytest.skip("no tables")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    result = queries()[name](spark, str(SF_DIR))
    relation = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(result.columns)
    want = sorted(relation.fetchall(), key=repr)
    got = sorted((tuple(r) for r in result.select(*columns).collect()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
