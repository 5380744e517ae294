"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphask.llm.columns import whole
from graphask.plans.lineage import stored

_ORDER = ["doc_id", "text_crc32", "size"]


def shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for documents ``doc_id, text``.

    Documents are put in the order of their ids (ties by checksum and size, so equal
    rows may trade places). Each range partition adds up its bytes and rows; the
    totals, one row per partition, become the offsets of the partitions, and a
    document goes to the shard in which the middle of its bytes falls. ``shard`` runs
    from 0 to ``n_shards - 1``, ``slot`` counts the documents of a shard from 0.

    Only ids, sizes and checksums are shuffled. A missing text has size 1 and the
    checksum of the empty text; missing ids come first; no documents give no rows;
    a document larger than a shard leaves shards empty. Other columns are ignored.
    """
    sized = docs.select(
        "doc_id",
        (F.octet_length(whole()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole()).alias("text_crc32"),
    )
    ranged = stored(
        sized.repartitionByRange(*_ORDER).withColumn("part", F.spark_partition_id()), "shard-sizes"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row per range partition, so both windows and the broadcast are bounded by the partition count.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    here = Window.partitionBy("part").orderBy(*_ORDER)
    running = here.rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("bytes_before") + F.sum("size").over(running)
    placed = ranged.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (2 * end - F.col("size")).alias("twice_middle"),
        "all_bytes",
        (F.col("rows_before") + F.row_number().over(here) - 1).alias("position"),
    )
    cut = F.least(
        F.lit(n_shards - 1), F.floor(F.col("twice_middle") * n_shards / (2 * F.col("all_bytes"))).cast("int")
    )
    numbered = stored(placed.select("doc_id", "size", "text_crc32", cut.alias("shard"), "position"), "shard-positions")
    first = numbered.groupBy("shard").agg(F.min("position").alias("first"))
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot")
    )


def shard_digest(docs: DataFrame) -> DataFrame:
    """:func:`shards` with the law it keeps; ``grown_shard`` belongs to another law and is null."""
    return shards(docs).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
