"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphask.plans.lineage import stored


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b``; the component is its smallest node.

    Each round lets every node point its larger neighbours, then its smaller ones, to
    the smallest node it knows. The number of rounds grows with the logarithm of the
    longest chain; every round is written to the shared folder, minima are combined
    before the shuffle, and the driver sees a count and a checksum only. Nodes
    without a link are not listed; null ends and loops are ignored.
    """
    current = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    signature = _signature(current)
    while True:
        both = current.selectExpr("hi AS u", "lo AS v").unionAll(current.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest, "hi").where("lo <> m").selectExpr("lo AS hi", "m AS lo")
        current = stored(small.unionAll(smallest.selectExpr("hi", "m AS lo")).distinct(), "links")
        before, signature = signature, _signature(current)
        if signature == before:
            break
    members = current.selectExpr("hi AS node", "lo AS component")
    return members.unionAll(current.selectExpr("lo AS node", "lo AS component").distinct())
