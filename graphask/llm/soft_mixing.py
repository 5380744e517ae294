"""Mixing with soft membership: domain posteriors from a labelled table, document rates from least squares.

Only built-in column functions are used on the tables; the driver keeps one number
per domain and the counts of a bounded vocabulary.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphask.llm.columns import whole, words
from graphask.plans.lineage import stored

#: Bounds of the fitted classifier: labelled rows, words and hash buckets.
LABELLED_ROWS = 4_000
VOCABULARY = 256
BUCKETS = 2_048
#: Known words that count in full; more of them are scaled down to this many, so that posteriors stay soft.
EVIDENCE_WORDS = 8
ROUNDS = 40
#: Token shares of the mixture by language.
MIX_TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
TOLERANCE = 1e-9


def _terms(text: Column) -> Column:
    return words(F.lower(text))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _literal(values: Sequence, kind: str) -> Column:
    """An array as one literal; thousands of single ones make slow plans."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


@dataclass(frozen=True)
class DomainModel:
    """Naive Bayes over the hash buckets of frequent words."""

    domains: tuple[str, ...]
    vocabulary: tuple[str, ...]
    prior: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    def known(self, terms: Column) -> Column:
        """Buckets of the distinct words that the model knows."""
        return F.transform(F.array_intersect(terms, _literal(self.vocabulary, "string")), _bucket)

    def log_scores(self, known: str) -> list[Column]:
        """Log probability of each domain up to a constant, from a column of buckets; without any it is the prior."""
        scale = F.when(F.size(known) > EVIDENCE_WORDS, EVIDENCE_WORDS / F.size(known)).otherwise(F.lit(1.0))

        def evidence(weights: Sequence[float]) -> Column:
            each = _literal(weights, "double")
            return F.aggregate(known, F.lit(0.0), lambda acc, i: acc + F.get(each, i))

        return [math.log(p) + scale * evidence(w) for p, w in zip(self.prior, self.weights, strict=True)]


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: the languages of the documents that a table of labels covers."""
    return docs.selectExpr("doc_id", "lang AS domain").join(labels.select("doc_id").distinct(), "doc_id")


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: Sequence[str], rows: int = LABELLED_ROWS, vocabulary: int = VOCABULARY
) -> DomainModel:
    """Count words by domain in at most ``rows`` labelled documents.

    ``labelled`` has ``doc_id, domain``; the rows with the smallest hashes of their ids
    are used, rows of other domains or without an id are not. The sample is the only
    bounded part: everything else sees every document. The most frequent words (ties in
    their order) make up the vocabulary. A domain without labelled rows keeps a small
    prior and flat weights.
    """
    sample = (
        labelled.select("doc_id", "domain")
        .where(F.col("domain").isin(list(domains)) & F.col("doc_id").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain")
        .limit(rows)
    )
    texts = docs.select("doc_id", whole().alias("text")).join(F.broadcast(sample), "doc_id")
    used = stored(texts.select("domain", F.array_distinct(_terms(F.col("text"))).alias("terms")), "mix-labelled")
    per_domain = {r["domain"]: r["n"] for r in used.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = used.select("domain", F.explode("terms").alias("term"))
    counts = seen.groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)]
    )
    top = counts.orderBy(F.desc("n"), "term").limit(vocabulary).withColumn("bucket", _bucket(F.col("term"))).collect()
    in_bucket: dict[int, list[int]] = defaultdict(lambda: [0] * len(domains))
    for row in top:
        for i in range(len(domains)):
            in_bucket[row["bucket"]][i] += row[f"d{i}"]
    n_rows = sum(per_domain.values())
    prior = [(per_domain.get(d, 0) + 1.0) / (n_rows + len(domains)) for d in domains]
    totals = [sum(b[i] for b in in_bucket.values()) for i in range(len(domains))]
    weights = [[0.0] * BUCKETS for _ in domains]
    for bucket, found in in_bucket.items():
        for i, n in enumerate(found):
            weights[i][bucket] = math.log((n + 0.5) / (totals[i] + 0.5 * len(in_bucket)))
    return DomainModel(tuple(domains), tuple(r["term"] for r in top), tuple(prior), tuple(map(tuple, weights)))


def memberships(docs: DataFrame, model: DomainModel, column: str = "doc_id") -> DataFrame:
    """``column``, ``n_tokens`` and the domain posteriors ``p0, p1, ...``; a missing text has no tokens."""
    found = docs.select(column, _terms(whole()).alias("terms")).select(
        column, F.size("terms").cast("long").alias("n_tokens"), model.known(F.col("terms")).alias("known")
    )
    scores = [f"s{i}" for i in range(len(model.domains))]
    scored = found.select(
        column, "n_tokens", *[c.alias(name) for c, name in zip(model.log_scores("known"), scores, strict=True)]
    )
    top = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    shifted = scored.select(column, "n_tokens", *[F.exp(F.col(s) - top).alias(s) for s in scores])
    total = sum((F.col(s) for s in scores[1:]), F.col(scores[0]))
    return shifted.select(column, "n_tokens", *[(F.col(s) / total).alias(f"p{s[1:]}") for s in scores])


def _rate(price: Sequence[float]) -> Column:
    return F.greatest(F.lit(0.0), sum((F.col(f"p{i}") * p for i, p in enumerate(price)), F.lit(1.0)))


def fit_rates(members: DataFrame, targets: Sequence[float], rounds: int = ROUNDS) -> list[float]:
    """Steps along the posteriors that bring the expected domain tokens to their targets.

    Least squares over rates that are not negative, by projected gradient: a document's
    gradient is a combination of its posteriors, so the steps add up to one number per
    domain, ``rate = max(0, 1 + sum(step * posterior))``, and a round is one aggregate
    over all documents. A domain's step is scaled by its tokens, a bound of the
    curvature. Targets are multiples of all tokens; where they cannot be met the rounds end
    with the remaining error.
    """
    domains = range(len(targets))
    price = [0.0] * len(targets)
    for _ in range(rounds):
        share = [F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"all{i}") for i in domains]
        got = [F.sum(F.col("n_tokens") * _rate(price) * F.col(f"p{i}")).alias(f"got{i}") for i in domains]
        row = members.agg(F.sum("n_tokens").alias("n"), *share, *got).first()
        if not row["n"]:
            return price
        error = [row[f"got{i}"] / row["n"] - targets[i] for i in domains]
        if max(map(abs, error)) < TOLERANCE:
            return price
        price = [p - e / max(row[f"all{i}"] / row["n"], 1e-6) for i, (p, e) in enumerate(zip(price, error, strict=True))]
    return price


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate`` of every document ``doc_id, text``.

    ``rate`` is how often a document is to be used on average; over all documents,
    tokens times rate times posterior add up to the target share of every domain.
    ``targets`` are rescaled to shares. No shuffle carries texts; repeated rows are
    rated alike; no documents give no rows; other columns are ignored.
    """
    total = sum(targets.values())
    shares = [value / total for value in targets.values()]
    model = fit_domains(docs, labelled, list(targets))
    members = stored(memberships(docs, model), "mix-members")
    price = fit_rates(members, shares)
    named = [F.col(f"p{i}").alias(f"p_{domain}") for i, domain in enumerate(targets)]
    return members.select("doc_id", "n_tokens", *named, _rate(price).alias("rate"))


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies for a rate: rounded up or down by a hash of the id, right on average."""
    chance = F.pmod(F.xxhash64(F.lit("mix"), doc_id), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + chance + 1e-6).cast("int")


def mixed_without_loss(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """The documents, with all their columns, each as often as its rate asks for and once at least.

    The mixture is as long as it must be for the domain that is furthest above its
    target to stay whole, so rates are one or more and no document is lost; rates are
    rounded to whole copies by a hash of the id.
    """
    total = sum(targets.values())
    shares = [value / total for value in targets.values()]
    model = fit_domains(docs, labelled, list(targets))
    members = stored(memberships(docs, model), "mix-members")
    tokens = members.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"n{i}") for i in range(len(shares))]).first()
    longer = max([1.0, *(tokens[f"n{i}"] / tokens["n"] / s for i, s in enumerate(shares))]) if tokens["n"] else 1.0
    price = fit_rates(members, [s * longer for s in shares])
    # The rows travel as one column, so no name of theirs can clash with those added.
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    rated = memberships(packed, model, "row")
    times = F.greatest(copies(_rate(price), F.col("row")["doc_id"]), F.lit(1))
    return rated.select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")
