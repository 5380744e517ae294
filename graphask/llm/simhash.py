"""Near duplicates by fingerprints that differ in at most three bits.

Links are found by meeting in the middle. Two fingerprints at distance three or less
agree, but for at most one bit, outside of one of four 16-bit blocks and at most two
bits apart in the rest. So every fingerprint emits, with each block left out in turn,
itself and all variants with one flipped bit (half the radius, the odd bit falling in
the block left out): 196 keys. Keys that two fingerprints share are looked at again
with the block, where they must meet in the middle too. That makes every shared key a
proof of a link, so the members of a key link to its smallest one instead of to each
other, and a crowded key costs as much as its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from graphask.llm.components import components
from graphask.llm.textbytes import in_small_batches
from graphask.plans.lineage import stored

SEED = 42
SHINGLE = 3
RADIUS = 3
_BLOCK, _BLOCKS = 16, 4
_REST = 64 - _BLOCK
_CHUNK = 1 << 16
_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the three-word shingles of a text, zero without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(end + 1 for end in ends[:-1])]
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    ones = np.zeros((8, 8), dtype=np.int64)
    for first in range(0, n, _CHUNK):
        last = min(first + _CHUNK, n)
        spans = zip(starts[first:last], ends[first + width - 1 : last + width - 1], strict=True)
        hashes = np.frombuffer(b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans]), dtype=np.uint8)
        columns = hashes.reshape(-1, 8) + np.arange(0, 2048, 256)
        ones += np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of documents ``doc_id, text``, in their partitions."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(text.as_py()) for text in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "fingerprint"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return in_small_batches(texts).mapInArrow(run, schema)


def _turned(block: Column) -> Column:
    """The fingerprint turned so that ``block`` is on top."""
    by = (_BLOCKS - 1 - block) * _BLOCK
    return F.call_function("shiftleft", F.col("fingerprint"), by).bitwiseOR(
        F.call_function("shiftrightunsigned", F.col("fingerprint"), (64 - by) % 64)
    )


def _rest(turned: Column) -> Column:
    return turned.bitwiseAND(F.lit((1 << _REST) - 1))


def links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fingerprint`` values within the radius, as stars.

    One shuffle of 196 keys per fingerprint; what follows sees only keys with two
    fingerprints or more. Every link returned is verified.
    """
    flips = F.lit([0, *(1 << i for i in range(_REST))])
    block = F.floor(F.col("variant") / (_REST + 1)).cast("int")
    numbered = prints.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(_BLOCKS * (_REST + 1) - 1))).alias("variant"))
    keyed = numbered.select(
        "fingerprint",
        _rest(_turned(block))
        .bitwiseXOR(F.get(flips, F.col("variant") % (_REST + 1)))
        .bitwiseOR(F.call_function("shiftleft", block.cast("long"), F.lit(_REST)))
        .alias("key"),
    )
    same_key = Window.partitionBy("key")
    shared = stored(
        keyed.withColumn("lo", F.min("fingerprint").over(same_key))
        .withColumn("hi", F.max("fingerprint").over(same_key))
        .where("lo <> hi")
        .select("key", "fingerprint"),
        "simhash-shared",
    )
    top = F.call_function("shiftright", F.col("key"), F.lit(_REST)).cast("int")
    inside = shared.select(
        "key",
        "fingerprint",
        F.call_function("shiftrightunsigned", _turned(top), F.lit(_REST)).cast("int").alias("inside"),
        _rest(_turned(top)).bitwiseXOR(_rest(F.col("key"))).alias("flipped"),
    )
    bit = F.call_function("shiftleft", F.lit(1), F.col("i"))
    # One bit of the block left open: at most two bits apart outside and one inside.
    opened = inside.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(_BLOCK - 1)))).select(
        "fingerprint", "key", (F.col("i") * (1 << _BLOCK) + F.col("inside").bitwiseAND(F.bitwise_not(bit))).alias("meet"), F.lit(True).alias("near")
    )
    # Equal outside, up to three bits apart inside: one of the two within one bit of the middle, the other within two.
    ball = [0, *(1 << i for i in range(_BLOCK)), *((1 << i) | (1 << j) for i in range(_BLOCK) for j in range(i))]
    within = inside.where("flipped = 0").withColumn("z", F.explode(F.lit(ball))).select(
        "fingerprint",
        "key",
        (F.lit(_BLOCK << _BLOCK) + F.col("inside").bitwiseXOR(F.col("z"))).alias("meet"),
        (F.bit_count("z") <= 1).alias("near"),
    )
    centre = F.min(F.when(F.col("near"), F.col("fingerprint"))).over(Window.partitionBy("key", "meet"))
    found = opened.unionAll(within).select(F.col("fingerprint").alias("a"), centre.alias("b")).where("a <> b").distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (long) and ``component_id``, the smallest id reachable over links.

    Words are split at ASCII white space and A-Z lower-cased. A missing or empty text
    has fingerprint zero and links like any other. Documents without an id belong to
    their group but never name it; a group without any id has a null ``component_id``.
    Repeated rows come out as often as they come in, no documents give no rows, other
    columns are ignored. Copies share one fingerprint, which is looked up once.
    """
    prints = stored(fingerprints(docs), "simhash-prints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    linked = components(links(classes.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    named = linked.join(classes, "fingerprint")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("lowest"))
    reached = stored(named.join(lowest, "component").select("fingerprint", "lowest"), "simhash-reached")
    labelled = classes.join(reached, "fingerprint", "left").select(
        "fingerprint", F.coalesce("lowest", "first_id").alias("component_id")
    )
    return prints.join(labelled, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id names their group, once each; documents without an id stay. All columns are kept."""
    firsts = near_duplicates(docs).select(F.col("component_id").alias("_first_of_group")).distinct()
    kept = docs.join(firsts, docs["doc_id"] == firsts["_first_of_group"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def simhash_digest(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates` with the fingerprint as 16 hexadecimal digits."""
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return near_duplicates(docs).withColumn("fingerprint", digits)
