"""Spelling variants of words: pairs one edit apart by pivotal grams, and the chain of each word to its common form.

Bigrams have a global order, the rarest first. The prefix of a word are its first three
positional bigrams in that order and those as frequent as the third; its pivots are two
bigrams of the prefix that do not overlap and are rarest together, chosen by dynamic
programming. One edit leaves one of the two pivots whole, so of two words one edit apart
the one whose prefix ends earlier in the order has a pivot in the prefix of the other,
at a place at most one further. On one side of that pivot the words are then equal, the
edit being on the other side; the index is therefore joined by the pivot together with
all that stands before it, or with all that stands behind it, which implies the limit on
places. Where the other side is long, one edit spares its first or its last letters, and
these belong to the key too. What is left is verified by its edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphask.plans.lineage import stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 10
#: One occurrence in so many has a letter taken out.
SLIPS = 31
EDITS = 1
GRAM = 2
PREFIX = GRAM * EDITS + 1
PIVOTS = EDITS + 1
#: Letters at an end of a word's other side that belong to a key.
ENDS = 2
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: After lower-casing there are 90 letters, so there are at most so many bigrams.
MAX_GRAMS = 90 * 90


def count_words(docs: DataFrame, slips: int = SLIPS) -> DataFrame:
    """``word, n`` of the long words of all texts, some of whose occurrences lose a letter by a checksum.

    A missing text has no words, a missing id counts as an empty text in the checksum.
    Only ``A-Z`` are lower-cased. Runs of letters that are too short are left out before
    anything is shuffled, and words are counted in the partitions first.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", _CAPITALS, _SMALL).alias("run"))
    found = found.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("size")))
    word = F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run"))
    counts = found.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Place in the order and number of occurrences of every bigram of the words, at most ``MAX_GRAMS``."""
    places = F.explode(F.sequence(F.lit(1), F.length("word") - GRAM + 1))
    grams = words.select("word", places.alias("at")).select(F.col("word").substr(F.col("at"), F.lit(GRAM)).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).limit(MAX_GRAMS + 1).collect()
    if len(counted) > MAX_GRAMS:
        raise ValueError("words have letters outside of the alphabet")
    ordered = sorted((r["n"], r["gram"]) for r in counted)
    return {gram: (place, n) for place, (n, gram) in enumerate(ordered)}


def prefix(word: str, order: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """``(order, place)`` of the first bigrams of the word in the global order, with those equal to the last of them."""
    grams = sorted((order[word[i : i + GRAM]][0], i) for i in range(len(word) - GRAM + 1))
    last = grams[PREFIX - 1][0]
    return [g for g in grams if g[0] <= last]


def pivots(places: Sequence[int], costs: Sequence[int], wanted: int = PIVOTS) -> list[int]:
    """``wanted`` of the sorted places at least ``GRAM`` apart whose costs are least in sum; of equal ones the first."""
    # best[k][i]: cost and choice of k of the first i places.
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] * (len(places) + 1)]
    for k in range(1, wanted + 1):
        row: list[tuple[int, tuple[int, ...]] | None] = [None]
        for i, (place, cost) in enumerate(zip(places, costs, strict=True)):
            free = sum(p <= place - GRAM for p in places[:i])
            before = best[k - 1][free]
            taken = (before[0] + cost, (*before[1], place)) if before else None
            row.append(min((x for x in (row[i], taken) if x), default=None))
        best.append(row)
    return list(best[wanted][-1][1])


def keys(word: str, place: int) -> list[str]:
    """What a word one edit away has in common with ``word`` if the edit spares the bigram at ``place``.

    The bigram with all on one side of it is equal, and of the other side the first or
    the last letters. A side of up to twice ``ENDS`` letters is left out, as a letter
    may be missing there.
    """
    out = []
    for mark, equal, other in (("<", word[: place + GRAM], word[place + GRAM :]), (">", word[place:], word[:place])):
        if len(other) <= 2 * ENDS:
            out.append(f"{mark}{equal}")
        if len(other) >= 2 * ENDS:
            out += [f"{mark}{equal}{mark}{other[:ENDS]}", f"{mark}{equal}|{other[-ENDS:]}"]
    return out


def signatures(words: DataFrame) -> DataFrame:
    """``word, n, last, pivots, grams``: where the prefix ends, and the keys of the pivots and of the whole prefix."""
    order = gram_order(words)

    def of(word: str) -> tuple[int, list[str], list[str]]:
        grams = prefix(word, order)
        places = sorted(i for _, i in grams)
        chosen = pivots(places, [order[word[i : i + GRAM]][1] for i in places])
        return grams[-1][0], [k for i in chosen for k in keys(word, i)], [k for i in places for k in keys(word, i)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.string())
        for batch in batches:
            made = [of(word) for word in batch.column("word").to_pylist()]
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int32(), lists, lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], ["word", "n", "last", "pivots", "grams"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, last int, pivots array<string>, grams array<string>")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``: every two of the words ``word, n`` that are exactly one edit apart, once, ``a`` before ``b``."""
    signed = stored(signatures(words), "word-signatures")
    size = F.length("word").alias("size")
    # A hash of the key travels; texts that share one by chance are verified like all others.
    owners = signed.select(F.explode("pivots").alias("key"), "word", "n", "last", size)
    owners = owners.withColumn("key", F.xxhash64("key"))
    index = signed.select(F.explode("grams").alias("key"), *(F.col(c).alias(f"{c}_2") for c in ("word", "n", "last")), size.alias("size_2"))
    index = index.withColumn("key", F.xxhash64("key"))
    # Of equal ends both words look in the other's prefix; one of the two is enough.
    looks = (F.col("last") < F.col("last_2")) | ((F.col("last") == F.col("last_2")) & (F.col("word") != F.col("word_2")))
    met = owners.join(index, "key").where(looks & (F.abs(F.col("size") - F.col("size_2")) <= EDITS))
    near = met.where(F.levenshtein("word", "word_2", EDITS) == EDITS)
    first = F.col("word") < F.col("word_2")

    def either(a: str, b: str):
        return F.when(first, F.col(a)).otherwise(F.col(b))

    return near.select(
        either("word", "word_2").alias("a"),
        either("word_2", "word").alias("b"),
        either("n", "n_2").alias("n_a"),
        either("n_2", "n").alias("n_b"),
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a ``form``: the end of the chain of forms, each way doubled in a round.

    A form occurs many times as often as its word, so chains are short and have no cycles.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(ways.join(onward, "root", "left"), "word-roots")
        moved = longer.where("next IS NOT NULL").limit(1).count()
        ways = longer.select("word", F.coalesce("next", "root").alias("root"))
        if not moved:
            return ways


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every long word that occurs twice in the texts of ``doc_id, text``.

    The form of a word is the most frequent word one edit away (of equally frequent ones
    the first in code-point order), if it occurs ten times as often; ``root`` follows
    forms to the last and is the word itself without a form. Texts of any length are read
    whole; repeated rows count again; no documents and texts without long words give no
    rows; other columns are ignored.
    """
    words = stored(count_words(docs), "words")
    pairs = stored(near_pairs(words), "word-pairs")
    both = pairs.selectExpr("a AS word", "n_a AS n", "b AS near", "n_b AS near_n").unionAll(
        pairs.selectExpr("b AS word", "n_b AS n", "a AS near", "n_a AS near_n")
    )
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    found = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    common = F.col("best.near_n") >= FORM_RATIO * F.col("n")
    found = stored(
        found.select(
            "word", "n_near", F.when(common, F.col("best.near")).alias("form"), F.when(common, F.col("best.near_n")).alias("form_n")
        ),
        "word-forms",
    )
    ends = roots(found.where("form IS NOT NULL"))
    return words.join(found, "word", "left").join(ends, "word", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "form_n",
    )
