"""Words of Arrow text columns as arrays: byte spans and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Rows that travel to a Python worker at a time where the session has not chosen a number: texts may be long.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPARK_DEFAULT = "10000"
#: Bytes of text handled at a time; a longer text or word makes its piece longer.
PIECE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def in_small_batches(texts: DataFrame) -> DataFrame:
    """The table, in a session whose Arrow batches suit texts; a setting other than Spark's default stays."""
    conf = texts.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _SPARK_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return texts


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a missing text is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


@dataclass(frozen=True)
class Words:
    """Words of a run of documents ``first, first + 1, ...``: byte spans, owner and the bytes they point into."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: int
    n_docs: int

    def hashes(self, data: np.ndarray | None = None, together: int = 48) -> np.ndarray:
        """A hash of all bytes of each word; those after the first ``together`` are hashed word by word."""
        data = self.data if data is None else data
        size = self.end - self.start
        hashed = size.astype(np.uint64) * _ODD
        live = np.arange(len(size))
        for i in range(min(together, int(size.max(initial=0)))):
            live = live[size[live] > i]
            hashed[live] = (hashed[live] ^ data[self.start[live] + i]) * _MIX + np.uint64(i + 1)
        for at in np.flatnonzero(size > together):
            rest = data[self.start[at] + together : self.end[at]].tobytes()
            hashed[at] ^= np.uint64(xxhash.xxh64_intdigest(rest))
        return mixed(hashed)


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Words]:
    """Words of the column in runs of whole documents of about ``size`` bytes."""
    data, ends = buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        lo, hi = int(ends[first]), int(ends[last])
        part = data[lo:hi]
        inside = np.zeros(hi - lo + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[part]
        bounds = ends[first : last + 1] - lo
        begins = inside[1:-1] & ~inside[:-2]
        finishes = inside[1:-1] & ~inside[2:]
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < hi - lo)]
        begins[cut] = inside[1:-1][cut]
        finishes[cut - 1] = inside[1:-1][cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        doc = np.searchsorted(bounds, start, "right") - 1
        yield Words(part, start, end, doc, first, last - first)
        first = last
