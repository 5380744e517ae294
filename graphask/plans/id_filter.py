"""Rows that cannot meet the other side of a join are dropped before the shuffle, by a bitmap of hashed keys.

The bitmap has a fixed number of bits, so its broadcast is bounded whatever the number of
keys. A row whose bit is not set has no partner; a few others pass and are dropped by
the join. With far more keys than bits it lets everything through and is only a waste.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: at most 16 MB in pieces of 4 kB.
BITS = 1 << 27


def _place(key: str) -> Column:
    # Bitmap places count from 1 on, in pieces of 32 768.
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """``_piece, _bits``: the hashed keys as bitmaps, built in the partitions and merged."""
    place = _place(key)
    return (
        keys.where(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("_piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    )


def possible(rows: DataFrame, key: str, partners: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among those of ``partners``; none that is among them is lost."""
    place = _place(key)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    is_set = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    pieces = F.broadcast(key_bitmap(partners, key))
    met = rows.withColumn("_piece", F.bitmap_bucket_number(place)).join(pieces, "_piece")
    return met.where(is_set).select(*rows.columns)
