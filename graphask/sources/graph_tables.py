"""Property-graph tables: nodes partitioned by label, edges by relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphask import schemas

NULL_MARKER = "\\N"


def props_from_columns(fields: Sequence[str]) -> Column:
    """A property map over real columns; only the listed columns are ever scanned."""
    return F.create_map(*[part for field in fields for part in (F.lit(field), F.col(f"`{field}`"))])


def read_nodes(
    spark: SparkSession,
    path: str,
    fields: Sequence[str] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Nodes as ``node_id, label, name, props``.

    With ``fields`` the file holds one real column per property; without, it
    holds the ``props`` map. CSV exports mark nulls with ``\\N``.
    """
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, nullValue=NULL_MARKER)
    else:
        raw = spark.read.format(fmt).load(path)
    props = F.col("props") if fields is None else props_from_columns(fields)
    return raw.select(F.col("node_id").cast("long").alias("node_id"), "label", "name", props.alias("props"))


def node_scan_source(nodes: DataFrame, label: str) -> DataFrame:
    """The nodes of one label; prunes partitions on tables written by :func:`write_nodes`."""
    return nodes.where(F.col("label") == label)


def write_nodes(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    nodes.write.mode(mode).partitionBy("label").parquet(path)


def read_edges(spark: SparkSession, path: str, rel: str | None = None) -> DataFrame:
    edges = spark.read.schema(schemas.EDGES).parquet(path)
    return edges if rel is None else edges.where(F.col("rel") == rel)


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    edges.write.mode(mode).partitionBy("rel").parquet(path)


def write_clustered_graph(nodes: DataFrame, edges: DataFrame, name: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """Tables ``{name}_nodes``, ``{name}_names`` and ``{name}_edges``, bucketed and sorted by the keys that asks join on.

    Nodes lie by label and name, edges by relation and target, and the names of the
    nodes once more by id, for the sources that were reached. With as many ``buckets`` as
    shuffle partitions, or a multiple, only the asks are shuffled. A hot name or target
    fills one bucket; many of them ask for :func:`write_nodes` and salted joins instead. The
    tables lie under ``path``, or in the warehouse.
    """

    def cluster(table: DataFrame, suffix: str, *keys: str) -> None:
        writer = table.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
        if path is not None:
            writer = writer.option("path", f"{path}/{suffix}")
        writer.saveAsTable(f"{name}_{suffix}")

    cluster(nodes.select("node_id", "label", "name", "props"), "nodes", "label", "name")
    cluster(nodes.select(F.col("node_id").alias("src_id"), F.col("name").alias("source_name")), "names", "src_id")
    cluster(edges.select("src_id", "rel", "dst_id"), "edges", "rel", "dst_id")


def read_clustered_graph(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and ``src_id, source_name`` of a graph written by :func:`write_clustered_graph`."""
    return spark.table(f"{name}_nodes"), spark.table(f"{name}_edges"), spark.table(f"{name}_names")
