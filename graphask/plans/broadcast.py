"""Broadcast hints that are only given after the side has been measured."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
_FIXED_WIDTH = 8


class Size(NamedTuple):
    rows: int
    bytes: int

    def within(self, max_rows: int, max_bytes: int) -> bool:
        return self.rows <= max_rows and self.bytes <= max_bytes


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, with all that lists, maps and structs hold."""
    nothing = F.lit(0).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value).cast("long"), nothing)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            held = F.array_size(value).cast("long") * _FIXED_WIDTH
        else:
            held = F.aggregate(value, nothing, lambda sum_, item: sum_ + _bytes_of(item, kind.elementType))
        return F.coalesce(held, nothing)
    if isinstance(kind, T.MapType):
        keys = _bytes_of(F.map_keys(value), T.ArrayType(kind.keyType))
        return keys + _bytes_of(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        width = nothing
        for field in kind.fields:
            width = width + _bytes_of(value[field.name], field.dataType)
        return width
    return F.lit(_FIXED_WIDTH).cast("long")


def _row_bytes(df: DataFrame) -> Column:
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        width = width + _bytes_of(F.col(f"`{field.name}`"), field.dataType)
    return width


def size_columns(df: DataFrame) -> list[Column]:
    """Aggregates ``rows`` and ``bytes`` (the payload, nested values included)."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("bytes"),
    ]


def measure(df: DataFrame) -> Size:
    """Size of a table, in one distributed aggregate."""
    row = df.agg(*size_columns(df)).first()
    return Size(row["rows"], row["bytes"])


def broadcast_if_bounded(
    df: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
    size: Size | None = None,
) -> tuple[DataFrame, bool]:
    """Hint a broadcast when the measured size allows it.

    Returns the table and whether it was hinted; a caller that gets ``False``
    must take a shuffle path that copes with hot keys.
    """
    size = size or measure(df)
    if size.within(max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False
