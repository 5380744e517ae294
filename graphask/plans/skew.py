"""Joins that spread hot keys over many tasks.

Only the side that can repeat a key is counted. Every key with more rows than a task
should read is hot. The hot keys stay a table; at most ``MAX_HOT_KEYS`` keys can hold
more than that share of all rows, so the table may always be broadcast. Nothing is
dropped or capped.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphask.plans.broadcast import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, broadcast_if_bounded, measure
from graphask.plans.lineage import cut_lineage

MAX_HOT_KEYS = MAX_BROADCAST_ROWS
ROWS_PER_TASK = 1_000_000
#: Keys that are broadcast for :func:`frequent_join`, and bytes that their rows should have.
FREQUENT_KEYS = MAX_BROADCAST_ROWS // 2
FREQUENT_BYTES = MAX_BROADCAST_BYTES // 2
_SALT = "_salt"
_N_SALTS = "_n_salts"


class HotKeys(NamedTuple):
    """Key columns, and the table of the hot keys with their salt counts, if there are any."""

    keys: list[str]
    table: DataFrame | None

    def __bool__(self) -> bool:
        return self.table is not None


def find_hot_keys(
    counts: DataFrame,
    keys: Sequence[str],
    n: str = "n",
    rows_per_task: int = ROWS_PER_TASK,
) -> HotKeys:
    """Pick hot keys from per-key counts (``groupBy(keys).count()``, combined map-side).

    Hot is a key with more than ``rows_per_task`` rows; where there are more than
    ``MAX_HOT_KEYS * rows_per_task`` rows in all, one with more than its share of them.
    """
    sizes = counts.agg(F.sum(n).alias("rows"), F.count_if(F.col(n) > rows_per_task).alias("hot")).first()
    if not sizes["hot"]:
        return HotKeys(list(keys), None)
    least = max(rows_per_task, sizes["rows"] // MAX_HOT_KEYS)
    salts = F.greatest(F.lit(2), F.ceil(F.col(n) / rows_per_task).cast("int"))
    return HotKeys(list(keys), cut_lineage(counts.where(F.col(n) > least).select(*keys, salts.alias(_N_SALTS))))


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    hot: HotKeys | None,
    spread_by: str,
    how: str = "inner",
) -> DataFrame:
    """``many`` joined to ``one``, the hot keys of ``many`` spread by a hash of ``spread_by``.

    The rows of ``one`` that carry a hot key are repeated once per salt. Without
    hot keys this is the plain join. The hot keys may cover only some of ``keys``.
    """
    keys = list(keys)
    if not hot:
        return many.join(one, keys, how)
    hot_keys = F.broadcast(hot.table)
    n_salts = F.coalesce(F.col(_N_SALTS), F.lit(1))
    left = (
        many.join(hot_keys, hot.keys, "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(spread_by), n_salts).cast("int"))
        .drop(_N_SALTS)
    )
    right = (
        one.join(hot_keys, hot.keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), n_salts - 1)))
        .drop(_N_SALTS)
    )
    return left.join(right, [*keys, _SALT], how).drop(_SALT)


def frequent_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, spread_by: str) -> DataFrame:
    """``many`` joined to ``one``, which is too large to broadcast: the rows of its most frequent keys are, and only
    the rows of ``many`` with other keys are shuffled.

    ``counts`` has ``key, n`` of ``many``. The rows with frequent keys stay where they are, so sums over
    neighbouring rows are combined before a shuffle. ``many`` is read twice.
    """
    counts = cut_lineage(counts.where(F.col(key).isNotNull()).select(key, "n"))
    size = measure(one)
    most = min(FREQUENT_KEYS, FREQUENT_BYTES * size.rows // max(size.bytes, 1))
    # Keys by the logarithm of their count, the largest first: a few rows.
    least, held = None, 0
    for row in sorted(counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        least = 1 << row["power"]
    if least is None:
        return salted_join(many, one, [key], find_hot_keys(counts, [key]), spread_by)
    frequent = F.broadcast(cut_lineage(counts.where(F.col("n") >= least).select(key)))
    head, bounded = broadcast_if_bounded(one.join(frequent, key, "left_semi"))
    if not bounded:
        return salted_join(many, one, [key], find_hot_keys(counts, [key]), spread_by)
    rare = counts.where(F.col("n") < least)
    rest, others = many.join(frequent, key, "left_anti"), one.join(frequent, key, "left_anti")
    return many.join(head, key).unionByName(salted_join(rest, others, [key], find_hot_keys(rare, [key]), spread_by))
