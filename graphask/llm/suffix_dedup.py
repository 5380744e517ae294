"""Removal of long byte strings that an earlier document also has, by suffix arrays of anchored contexts.

Documents live in blocks, anchors in buckets; both grow with the data and every step
handles one block or one bucket.

1. A block picks anchors: 24-byte strings whose hash is the least in some window of
   50 bytes. Equal 50-byte strings hold equal anchors at equal places. It sends the
   distinct hashes to their buckets, which answer whether another document has them.
2. For anchors that repeat, a block sends each distinct context (26 bytes to either
   side) with the first document that has it.
3. A bucket sorts the contexts as suffixes from their anchor and as reversed prefixes,
   with the common lengths of neighbours. A level of the interval tree, the suffixes
   that agree for ``d`` bytes, is a run of common lengths of ``d`` or more; within an
   interval, left extensions of ``50 - d`` bytes split it into all occurrences of one
   50-byte string. The first document among them decides.
4. A block joins the removed 50-byte strings of each document to spans.

A repeat of any length is the union of its 50-byte strings, so spans are exact without
suffixes longer than a context, and no text leaves its block but for the contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphask.llm.textbytes import buffers, mixed

LENGTH = 50
#: Text in a block, and the most blocks (their numbers take two bytes); more text makes blocks larger.
PART_BYTES = 1 << 22
MAX_PARTS = 1 << 16
_GRAM = 24
_SIDE = LENGTH - _GRAM
_CONTEXT = _SIDE + LENGTH
_PIECE = 1 << 20
_NONE = np.uint64(2**64 - 1)
_NO_ID = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = left * _ODD + right
    return both ^ (both >> np.uint64(29))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each place on, ``_GRAM`` of them."""
    hashes, width, eight = (data.astype(np.uint64) + np.uint64(1)) * _ODD, 1, None
    while width < 16:
        hashes = _paired(hashes[:-width], hashes[width:])
        width *= 2
        eight = hashes if width == 8 else eight
    return mixed(_paired(hashes[: len(data) - _GRAM + 1], eight[16 : 16 + len(data) - _GRAM + 1]))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents that lie one after the other."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    width = LENGTH - _GRAM + 1
    for lo in range(0, len(data), _PIECE):
        part = data[lo : lo + _PIECE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        grams = _grams(part)
        ends = bounds[(bounds > lo) & (bounds < lo + len(part))] - lo
        over = (ends[:, None] - np.arange(1, _GRAM)).ravel()
        grams[over[(over >= 0) & (over < len(grams))]] = _NONE
        least = _sliding(grams, width, np.minimum)
        padded = np.zeros(len(grams) + width - 1, np.uint64)
        padded[width - 1 : width - 1 + len(least)] = least
        found = np.flatnonzero((grams == _sliding(padded, width, np.maximum)) & (grams != _NONE))
        places.append(found + lo)
        hashes.append(grams[found])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


class _Block:
    """The documents of a block in the order of their ids and texts, and their anchors by bucket."""

    def __init__(self, table: pa.Table, n_buckets: int):
        table = table.select(["doc_id", "text"]).combine_chunks()
        ids = pc.fill_null(pc.cast(table["doc_id"], pa.int64()), _NO_ID)
        order = pc.sort_indices(pa.table({"id": ids, "text": table["text"]}), [("id", "ascending"), ("text", "ascending")])
        self.table = table.take(order)
        self.ids = ids.take(order).to_numpy(zero_copy_only=False)
        data, ends = buffers(self.table["text"])
        self.data, self.bounds = data[ends[0] : ends[-1]], ends - ends[0]
        self.place, hashes = anchors(self.data, self.bounds)
        self.doc = np.searchsorted(self.bounds, self.place, "right") - 1
        # Distinct hashes bucket by bucket, and the one of each anchor.
        bucket = hashes % np.uint64(n_buckets)
        tail = hashes >> np.uint64(24)
        keys = (bucket << np.uint64(40)) | tail
        self.keys, self.key_of = np.unique(keys, return_inverse=True)
        self.bucket = (self.keys >> np.uint64(40)).astype(np.int64)
        low, high = np.full(len(self.keys), _NO_ID), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.key_of, self.ids[self.doc])
        np.maximum.at(high, self.key_of, self.ids[self.doc])
        self.twice = low < high

    def spans_of_buckets(self, owner: np.ndarray) -> Iterator[tuple[int, slice]]:
        if not len(owner):
            return
        found, first = np.unique(owner, return_index=True)
        for bucket, lo, hi in zip(found, first, [*first[1:], len(owner)], strict=True):
            yield int(bucket), slice(int(lo), int(hi))

    def contexts(self, answers: dict[int, bytes]) -> None:
        """Contexts of the anchors whose keys repeat, the distinct ones ordered by bucket."""
        repeats = np.zeros(len(self.keys), dtype=bool)
        for bucket, where in self.spans_of_buckets(self.bucket):
            if bucket in answers:
                bits = np.frombuffer(answers[bucket], dtype=np.uint8)
                repeats[where] = np.unpackbits(bits, count=where.stop - where.start).astype(bool)
        chosen = repeats[self.key_of]
        self.at, self.at_doc = self.place[chosen], self.doc[chosen]
        before = np.minimum(self.at - self.bounds[self.at_doc], _SIDE)
        after = np.minimum(self.bounds[self.at_doc + 1] - self.at - _GRAM, _SIDE)
        rows = np.zeros((len(self.at), 4 + _CONTEXT), dtype=np.uint8)
        rows[:, :2] = self.bucket[self.key_of[chosen]].astype(">u2").view(np.uint8).reshape(-1, 2)
        rows[:, 2], rows[:, 3] = before + 1, after + 1
        offset = np.arange(_CONTEXT) - _SIDE
        for lo in range(0, len(rows), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            real = (offset >= -before[part, None]) & (offset < _GRAM + after[part, None])
            at = np.where(real, self.at[part, None] + offset, 0)
            rows[part, 4:] = np.where(real, self.data[at] if len(self.data) else 0, 0)
        self.before, self.after = before, after
        flat = rows.view(f"V{rows.shape[1]}").ravel()
        self.distinct, self.context_of = np.unique(flat.view(f"S{rows.shape[1]}"), return_inverse=True)
        self.first = np.full(len(self.distinct), _NO_ID)
        np.minimum.at(self.first, self.context_of, self.ids[self.at_doc])

    def context_buckets(self) -> np.ndarray:
        rows = self.distinct.view(np.uint8).reshape(-1, 4 + _CONTEXT)
        return rows[:, 0].astype(np.int64) * 256 + rows[:, 1]


def _blob(*parts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _common(words: np.ndarray) -> np.ndarray:
    """Bytes on which each row agrees with the row before, for rows of big-endian 64-bit words."""
    same = np.zeros(len(words), dtype=np.int64)
    differ = words[1:] ^ words[:-1]
    going = np.ones(len(differ), dtype=bool)
    for column in differ.T:
        length = np.full(len(column), 8)
        for byte in range(8):
            length = np.minimum(length, np.where((column >> np.uint64(56 - 8 * byte)) & np.uint64(255), byte, 8))
        same[1:] += np.where(going, length, 0)
        going &= column == 0
    return same


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows and the common lengths of neighbours in it."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    return order, _common(words[order])


def earlier_strings(contexts: np.ndarray, before: np.ndarray, after: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each context a bit for each left length ``L``: an earlier document has the 50 bytes from ``L`` before the anchor.

    ``contexts`` are rows of bytes with the anchor at ``_SIDE``, of which ``before`` and
    ``after`` bytes beside the anchor are real; ``first`` is the first document of each.
    """
    n = len(contexts)
    suffixes, agree = _ordered(contexts[:, _SIDE:])
    prefixes, agree_left = _ordered(contexts[:, _SIDE - 1 :: -1] if _SIDE else contexts[:, :0])
    bits = np.zeros(n, dtype=np.uint32)
    interval, extension = np.empty(n, np.int64), np.empty(n, np.int64)
    for left in range(_SIDE + 1):
        interval[suffixes] = np.cumsum(agree < LENGTH - left)
        extension[prefixes] = np.cumsum(agree_left < left)
        real = np.flatnonzero((before >= left) & (after >= _SIDE - left))
        if not len(real):
            continue
        group = interval[real] * (n + 1) + extension[real]
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        least = np.minimum.reduceat(first[real][order], starts)
        size = np.diff(np.r_[starts, len(order)])
        earlier = np.repeat(least, size) < first[real][order]
        bits[real[order[earlier]]] |= np.uint32(1 << left)
    return bits


def remove_repeats(docs: DataFrame, n_parts: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of documents ``doc_id, text``.

    ``spans`` are the maximal runs of bytes (``start``, ``end``) covered by 50-byte
    strings that a document with a smaller id also has, ``kept`` the remaining bytes.
    Only smaller ids count: rows with equal ids do not shorten each other, and rows
    without an id come after all others. A missing text is empty. Repeated rows come
    out as often as they come in; no documents give no rows; other columns are ignored.

    ``n_parts`` blocks and buckets are made, one for ``PART_BYTES`` of text unless given. The texts are shuffled once, 5 bytes go to a
    bucket for each anchor (one in 14 bytes of text), and contexts only where an anchor
    repeats. Contexts that a block repeats are sent once, so copies of a passage cost a
    bucket one row a block.
    """
    if n_parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_parts = size // PART_BYTES + 1
    parts = min(n_parts, MAX_PARTS)
    blocks = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("block"),
    )
    sent = "bucket int, block int, data binary"
    sent_on = "bucket int, block int, data binary, repeats binary"

    def rows(bucket: list[int], block: list[int], data: list[bytes], repeats: list[bytes] | None = None) -> pa.Table:
        columns = {
            "bucket": pa.array(bucket, pa.int32()),
            "block": pa.array(block, pa.int32()),
            "data": pa.array(data, pa.binary()),
        }
        if repeats is not None:
            columns["repeats"] = pa.array(repeats, pa.binary())
        return pa.table(columns)

    def by_bucket(answers: pa.Table, column: str) -> dict[int, bytes]:
        return dict(zip(answers["bucket"].to_pylist(), answers[column].to_pylist(), strict=True))

    def send_keys(key: tuple, table: pa.Table) -> pa.Table:
        block = _Block(table, parts)
        buckets, blobs = [], []
        for bucket, where in block.spans_of_buckets(block.bucket):
            tails = block.keys[where].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
            buckets.append(bucket)
            blobs.append(np.packbits(block.twice[where]).tobytes() + tails.tobytes())
        return rows(buckets, [key[0].as_py()] * len(buckets), blobs)

    def find_repeated(key: tuple, table: pa.Table) -> pa.Table:
        tails, twice, sizes = [], [], []
        for blob in table["data"].to_pylist():
            n = (len(blob) * 8) // 41
            while 5 * n + -(-n // 8) < len(blob):
                n += 1
            flags, tail = blob[: -(-n // 8)], blob[-(-n // 8) :]
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, 3:] = np.frombuffer(tail, dtype=np.uint8).reshape(n, 5)
            tails.append(wide.view(">u8").ravel().astype(np.uint64))
            twice.append(np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=n).astype(bool))
            sizes.append(n)
        _, inverse, counts = np.unique(np.concatenate(tails), return_inverse=True, return_counts=True)
        again = counts > 1
        np.logical_or.at(again, inverse, np.concatenate(twice))
        answers = np.split(again[inverse], np.cumsum(sizes)[:-1])
        return rows([key[0].as_py()] * len(sizes), table["block"].to_pylist(), [np.packbits(a).tobytes() for a in answers])

    def send_contexts(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, parts)
        repeats = by_bucket(answers, "data")
        block.contexts(repeats)
        buckets, blobs = [], []
        for bucket, where in block.spans_of_buckets(block.context_buckets()):
            buckets.append(bucket)
            blobs.append(_blob(block.first[where], block.distinct[where]))
        return rows(buckets, [key[0].as_py()] * len(buckets), blobs, [repeats[b] for b in buckets])

    def judge_contexts(key: tuple, table: pa.Table) -> pa.Table:
        firsts, contexts, sizes = [], [], []
        for blob in map(_open, table["data"].to_pylist()):
            n = len(blob) // (8 + 4 + _CONTEXT)
            firsts.append(np.frombuffer(blob, dtype=np.int64, count=n))
            contexts.append(np.frombuffer(blob, dtype=np.uint8, offset=8 * n).reshape(n, 4 + _CONTEXT))
            sizes.append(n)
        all_rows = np.concatenate(contexts)
        before, after = all_rows[:, 2].astype(np.int64) - 1, all_rows[:, 3].astype(np.int64) - 1
        bits = earlier_strings(all_rows[:, 4:], before, after, np.concatenate(firsts))
        answers = np.split(bits, np.cumsum(sizes)[:-1])
        given = table["repeats"].to_pylist()
        return rows([key[0].as_py()] * len(sizes), table["block"].to_pylist(), [_blob(a) for a in answers], given)

    out = pa.schema([
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
    ])

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, parts)
        block.contexts(by_bucket(answers, "repeats"))
        earlier = by_bucket(answers, "data")
        bits = np.zeros(len(block.distinct), dtype=np.uint32)
        for bucket, where in block.spans_of_buckets(block.context_buckets()):
            bits[where] = np.frombuffer(_open(earlier[bucket]), dtype=np.uint32)
        own = bits[block.context_of]
        own[block.first[block.context_of] < block.ids[block.at_doc]] = np.uint32(2**32 - 1)
        step = np.zeros(len(block.data) + 1, dtype=np.int32)
        begins = np.zeros(len(block.data), dtype=bool)
        for left in range(_SIDE + 1):
            fits = (block.before >= left) & (block.after >= _SIDE - left)
            begins[block.at[fits & ((own >> np.uint32(left)) & np.uint32(1)).astype(bool)] - left] = True
        begins = np.flatnonzero(begins)
        step[begins] += 1
        step[begins + LENGTH] -= 1
        gone = np.cumsum(step)[:-1] > 0
        spans, kept = [], []
        for lo, hi in zip(block.bounds[:-1], block.bounds[1:], strict=True):
            edges = np.diff(np.r_[False, gone[lo:hi], False].astype(np.int8))
            starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
            kept.append(block.data[lo:hi][~gone[lo:hi]].tobytes())
        ids = block.table["doc_id"].combine_chunks()
        sizes = pa.array(np.diff(block.bounds), pa.int64())
        return pa.Table.from_arrays([ids, sizes, pa.array(spans, out.field("spans").type), pa.array(kept, pa.binary())], schema=out)

    grouped = blocks.groupBy("block")
    keys = grouped.applyInArrow(send_keys, sent)
    repeated = keys.groupBy("bucket").applyInArrow(find_repeated, sent)
    contexts = grouped.cogroup(repeated.groupBy("block")).applyInArrow(send_contexts, sent_on)
    judged = contexts.groupBy("bucket").applyInArrow(judge_contexts, sent_on)
    return grouped.cogroup(judged.groupBy("block")).applyInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )


def repeat_digest(docs: DataFrame) -> DataFrame:
    """Counts of what :func:`remove_repeats` removes and a checksum of what it keeps."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
