"""Dense numbers for sorted rows without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphask.plans.lineage import cut_lineage


def with_position(rows: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Add the place of each row in the order of ``order``, from 0: ranges, their counts, offsets.

    The offsets have one row per range. Rows that are equal in ``order`` share a range,
    so the columns should tell most rows apart.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    place = F.col("_before") + F.row_number().over(inside) - 1
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, place).drop("_range", "_before")
