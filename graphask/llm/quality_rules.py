"""Weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything is built-in column functions. The rules' votes are counted by pattern,
at most ``3 ** len(RULES)`` rows, and each round of expectation-maximisation is one
aggregate over that table; two accuracies per rule and the share of good documents
are all that the driver keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphask.llm.columns import SPACE, count_of, whole, words
from graphask.plans.lineage import stored

ROUNDS = 12
#: Share of good documents, which stays fixed (texts on which no rule votes would otherwise draw it to any value),
#: and, before the first round, how often a rule votes against or for a good or a bad one.
PRIOR_GOOD = 0.85
START = {"against_good": 0.01, "against_bad": 0.3, "for_good": 0.9, "for_bad": 0.6}
PSEUDO_COUNT = 1.0
#: What makes the two classes mean quality: rules vote against few good documents and against some of the bad ones.
BOUNDS = {"against_good": (0.001, 0.01), "against_bad": (0.04, 0.999), "for_good": (0.8, 0.999), "for_bad": (0.8, 0.999)}
WINDOW = 5
_SYMBOLS = "#*$%&|<>"

#: name, condition of a vote against, condition of a vote for; SQL over the signals, otherwise the rule abstains.
#: Signs of one kind of junk say nothing about other kinds, so their absence is an abstention and not a vote for.
RULES = (
    ("length", "n_words < 10", "n_words >= 30"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words",
     "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "FALSE"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "FALSE"),
    ("lines", "10 * n_dup_lines > 5 * n_lines", "FALSE"),
    ("capitals", "10 * n_capitals > 4 * word_chars", "FALSE"),
    ("shouting", "10 * n_shouts > n_words", "FALSE"),
)


def repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the hashes of all ``WINDOW``-word windows in their order.

    64 bits are enough here: hashes are only compared within one text. Most texts repeat nothing and stop after the distinct count; the others sort
    (hash, position) pairs, so the cost stays close to linear however often a window
    repeats.
    """
    pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def starts(sorted_pairs: Column) -> Column:
        def same(e: Column, k: Column) -> Column:
            return F.coalesce(F.get(sorted_pairs, k)["w"] == e["w"], F.lit(False))

        twice = F.filter(sorted_pairs, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    # A one-element array binds the sorted pairs, which would otherwise be built anew for every element.
    covered = F.aggregate(
        F.element_at(F.transform(F.array(pairs), starts), 1),
        F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["covered"] + i + WINDOW - F.greatest(i, acc["end"])).alias("covered"), (i + WINDOW).alias("end")
        ),
    )["covered"]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0)).cast("long")


def signals(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that the rules look at, all long; a missing text counts as empty."""
    split = docs.select("doc_id", whole().alias("text"), words(whole()).alias("words"))
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    no_window = F.array().cast("array<bigint>")
    windows = split.withColumn("windows", F.when(F.size("words") >= WINDOW, hashes).otherwise(no_window))
    has_word = F.filter(F.split("text", "\\n"), lambda line: line.rlike(f"[^{SPACE[1:-1]}]"))
    marks = F.regexp_replace("text", f"[^{_SYMBOLS}!\\p{{Lu}}]+", "")
    counted = windows.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        has_word.alias("lines"),
        repeat_words(F.col("windows")).alias("n_repeat_words"),
        marks.alias("marks"),
    ).withColumns({
        "n_symbols": count_of(F.col("marks"), _SYMBOLS),
        "n_shouts": count_of(F.col("marks"), "!"),
        "n_capitals": F.length(F.translate("marks", f"{_SYMBOLS}!", "")),
    })
    lines = F.size("lines")
    names = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_capitals", "n_shouts")
    return counted.select(
        "doc_id",
        *[F.col(name).cast("long").alias(name) for name in names],
        lines.cast("long").alias("n_lines"),
        (lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )


def vote_sql(against: str, for_: str) -> str:
    return f"CASE WHEN {against} THEN -1 WHEN {for_} THEN 1 ELSE 0 END"


def odds_sql(rates: Callable[[str, str], str], prior: str) -> str:
    """Log odds of a good document; ``rates`` names the rate of a rule's vote in a class. An abstention weighs nothing."""
    terms = (
        f" + CASE {name} WHEN -1 THEN ln({rates(name, 'against_good')} / {rates(name, 'against_bad')})"
        f" WHEN 1 THEN ln({rates(name, 'for_good')} / {rates(name, 'for_bad')}) ELSE 0 END"
        for name, *_ in RULES
    )
    return f"ln({prior} / (1 - {prior}))" + "".join(terms)


def vote_sums_sql() -> dict[str, str]:
    """Sums over patterns of ``n`` documents, each good with probability ``q``, that a round needs."""
    sums = {"good": "sum(n * q)", "bad": "sum(n * (1 - q))"}
    for name, *_ in RULES:
        for vote, sign in (("against", -1), ("for", 1)):
            sums[f"{name}_{vote}_good"] = f"sum(CASE WHEN {name} = {sign} THEN n * q ELSE 0 END)"
            sums[f"{name}_{vote}_bad"] = f"sum(CASE WHEN {name} = {sign} THEN n * (1 - q) ELSE 0 END)"
    return sums


@dataclass(frozen=True)
class LabelModel:
    """By rule, how often it votes against or for good and bad ones."""

    rates: Mapping[str, Mapping[str, float]]

    @classmethod
    def start(cls) -> LabelModel:
        return cls({name: START for name, *_ in RULES})

    def posterior(self) -> Column:
        """Probability that a document with the votes in columns named after the rules is good."""
        odds = odds_sql(lambda name, rate: f"{self.rates[name][rate]!r}D", f"{PRIOR_GOOD}D")
        return F.expr(f"1 / (1 + exp(-({odds})))")


def fit_label_model(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over ``n`` documents per vote pattern, one aggregate a round.

    Without documents the starting values stay.
    """
    model = LabelModel.start()
    sums = [F.expr(sql).alias(name) for name, sql in vote_sums_sql().items()]
    for _ in range(rounds):
        row = patterns.withColumn("q", model.posterior()).agg(*sums).first().asDict()
        found = {name: value or 0.0 for name, value in row.items()}

        def rate(name: str, kind: str, found: dict[str, float] = found) -> float:
            total = found["good" if kind.endswith("good") else "bad"]
            least, most = BOUNDS[kind]
            smoothed = (found[f"{name}_{kind}"] + PSEUDO_COUNT * START[kind]) / (total + PSEUDO_COUNT)
            return min(max(smoothed, least), most)

        model = LabelModel({name: {kind: rate(name, kind) for kind in START} for name, *_ in RULES})
    return model


def rate_quality(docs: DataFrame) -> DataFrame:
    """The signals of every document ``doc_id, text``, its votes and ``posterior``, the probability that it is good.

    One pass over the texts writes the counts; the votes are counted by pattern with
    map-side combination, so no source or group of copies meets in one task. Repeated
    rows count as often as they occur; no documents give no rows; other columns are
    ignored.
    """
    counts = stored(signals(docs), "quality-signals")
    voted = counts.withColumns({name: F.expr(vote_sql(against, for_)) for name, against, for_ in RULES})
    names = [name for name, *_ in RULES]
    patterns = stored(voted.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")), "quality-votes")
    return voted.withColumn("posterior", fit_label_model(patterns).posterior())


def quality_digest(docs: DataFrame) -> DataFrame:
    """Counts, the fixed base rule and the verdict of the label model behind it."""
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return rate_quality(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= 0.5)).alias("kept"),
        F.round("posterior", 4).alias("posterior"),
    )
