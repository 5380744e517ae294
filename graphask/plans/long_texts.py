"""Joining long texts to the many rows that share them, so that the rows of one text lie together.

Columnar writers keep a dictionary of the distinct values of a chunk and give it up once it is too long,
by default at one megabyte in Parquet; then every row is written with its whole text. Rows that are dealt
by text before the join leave each task few long texts, so a text is written once a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphask.plans.broadcast import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS
from graphask.plans.lineage import cut_lineage
from graphask.plans.skew import ROWS_PER_TASK, HotKeys, salted_join

#: Bytes of a long text and rows that share it; others may be written with every row.
LONG_BYTES = 1024
SHARED_ROWS = 8
#: Bytes of the texts that share a task; a text over half of that has a task of its own.
BYTES_PER_TASK = 512 * 1024
#: Long texts are sent to the tasks in about so many broadcasts at most; if there are more, the join shuffles them.
MAX_BROADCASTS = 16


def join_long_texts(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    text: str,
    counts: DataFrame,
    hot: HotKeys,
    spread_by: str,
    rows_per_task: int = ROWS_PER_TASK,
    long_bytes: int = LONG_BYTES,
    broadcast_bytes: int = MAX_BROADCAST_BYTES // 2,
) -> DataFrame:
    """``many`` joined to ``one``, which has one row per ``keys`` and is read several times.

    ``counts`` has ``n``, the rows of ``many`` per key, for all or some of ``keys``. Other texts, and all
    texts where the long ones exceed :data:`MAX_BROADCASTS`, take :func:`salted_join`.
    """
    keys = list(keys)
    by = [key for key in keys if key in counts.columns]
    sized = (
        one.select(*keys, F.octet_length(text).alias("_bytes"))
        .where(F.col("_bytes") > long_bytes)
        .join(counts.where(F.col("n") >= SHARED_ROWS).select(*by, "n"), by)
    )
    size = sized.agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes")).first()
    if not size["rows"] or size["rows"] > MAX_BROADCAST_ROWS or size["bytes"] > MAX_BROADCASTS * broadcast_bytes:
        return salted_join(many, one, keys, hot, spread_by)

    share = F.greatest(F.col("_bytes") / BYTES_PER_TASK, F.col("n") / rows_per_task)
    # At most ``MAX_BROADCAST_ROWS`` keys without their texts, so a window over all of them is bounded.
    before = Window.orderBy("_alone", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumns({"_alone": share > 0.5, "_n_tasks": F.ceil(F.col("n") / rows_per_task).cast("int")}).select(
        *keys,
        "_alone",
        F.when(F.col("_alone"), F.col("_n_tasks")).otherwise(1).alias("_n_tasks"),
        # The texts that share tasks come first, as many to a task as fill it; each of the others has its own.
        F.floor(F.sum(F.when(F.col("_alone"), 0.0).otherwise(share)).over(before)).alias("_full"),
        F.sum(F.when(F.col("_alone"), F.col("_n_tasks")).otherwise(0)).over(before).alias("_taken"),
        F.floor(F.sum("_bytes").over(before) / broadcast_bytes).cast("int").alias("_sent"),
    )
    task = F.when(F.col("_alone"), F.col("_full") + 1 + F.col("_taken") - F.col("_n_tasks")).otherwise(F.col("_full"))
    places = cut_lineage(placed.select(*keys, "_n_tasks", "_sent", task.cast("int").alias("_task")))
    long_keys = F.broadcast(places.select(*keys))
    joined = salted_join(many, one.join(long_keys, keys, "left_anti"), keys, hot, spread_by)
    long_texts = one.join(F.broadcast(places.select(*keys, "_sent")), keys)
    piece = F.pmod(F.xxhash64(spread_by), F.col("_n_tasks")).cast("int")
    dealt = many.join(F.broadcast(places), keys).withColumn("_task", F.col("_task") + piece)
    tasks = places.groupBy("_sent").agg(F.min("_task").alias("first"), F.max(F.col("_task") + F.col("_n_tasks")).alias("end"))
    for sent, first, end in tasks.orderBy("_sent").collect():
        rows = dealt.where(F.col("_sent") == sent).repartitionById(end - first, F.col("_task") - first)
        texts = F.broadcast(long_texts.where(F.col("_sent") == sent).drop("_sent"))
        joined = joined.unionByName(rows.drop("_task", "_n_tasks", "_sent").join(texts, keys))
    return joined
