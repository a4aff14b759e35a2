"""Mixing documents to target weights with soft memberships, by DataFrame functions alone.

A Gaussian naive Bayes classifier, learned from a labelled table, gives each
document its posteriors over the domains. Nonnegative rates (how often a
document is used) then solve the least-squares problem

    minimise  sum over domains k of  (total_k(rates) - target_k) ** 2 / mass_k
    total_k(rates) = sum over documents i of  posterior_ik * tokens_i * rate_i

by projected gradients. With mass_k = total_k(1), and the step of document i
divided by tokens_i, the gradient's largest curvature is 1, which makes 1 the
step. A document's rate depends on its posteriors and on the domains' errors so
far, a few numbers for each round, so a round is one aggregation and no row is
kept between rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.llm.shared import written


# Characters whose shares the classifier sees.
CHARACTERS = (".", "|", "#", "$", "%", "&", "*", "!", "\n")
FEATURES = 5 + len(CHARACTERS)


def with_features(documents: DataFrame) -> DataFrame:
    """``documents`` with mix_tokens and mix_x, what the classifier sees of a text: lengths and shares."""

    def count(what: str) -> Column:
        return F.col("mix_size") - F.length(F.replace("mix_text", F.lit(what), F.lit("")))

    out = documents.withColumn("mix_text", F.coalesce("text", F.lit("")))
    out = out.withColumns({"mix_size": F.length("mix_text"), "mix_lines": F.split("mix_text", "\n")})
    out = out.withColumns({"mix_least": F.greatest("mix_size", F.lit(1)), "mix_blanks": count(" "), "mix_breaks": F.size("mix_lines")})
    x = [
        F.log1p(F.col("mix_size").cast("double")),
        F.log(F.col("mix_least") / (F.col("mix_blanks") + 1)),
        F.size(F.array_distinct("mix_lines")) / F.col("mix_breaks"),
        F.log(F.col("mix_least") / F.col("mix_breaks")),
        (F.octet_length("mix_text") - F.col("mix_size")) / F.col("mix_least"),
        *(F.log1p(count(c) * 100 / F.col("mix_least")) for c in CHARACTERS),
    ]
    tokens = F.when(F.col("mix_size") == 0, 0).otherwise(F.col("mix_blanks") + F.col("mix_breaks")).cast("long")
    return out.withColumns({"mix_tokens": tokens, "mix_x": F.array(*x)}).drop("mix_text", "mix_size", "mix_lines", "mix_least", "mix_blanks", "mix_breaks")


def numbers(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


@dataclass(frozen=True)
class Mixture:
    """Plain numbers: for each domain its prior, means and variances, and the steps of the rates."""

    domains: list[int]
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]
    least_rate: float = 0.0
    steps: tuple[tuple[float, ...], ...] = ()

    def scores(self, x: Column) -> Column:
        """Log densities of the features x, one for each domain; without a domain all documents are in one."""
        if not self.domains:
            return F.array(F.lit(0.0))
        scores = []
        for prior, means, variances in zip(self.priors, self.means, self.variances, strict=True):
            squares = F.zip_with(x, numbers(means), lambda a, m: (a - m) * (a - m))
            parts = F.zip_with(squares, numbers([1 / (2 * v) for v in variances]), lambda a, w: a * w)
            constant = math.log(prior) - sum(math.log(2 * math.pi * v) for v in variances) / 2
            scores.append(F.lit(constant) - F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))
        return F.array(*scores)

    def posteriors(self, scores: Column) -> Column:
        k = range(max(1, len(self.domains)))
        sums = [sum((F.exp(F.least(scores[j] - scores[i], F.lit(700.0))) for j in k), F.lit(0.0)) for i in k]
        return F.array(*(1 / s for s in sums))

    def rate(self, p: Column) -> Column:
        """Of the posteriors p: all steps, one after the other; they are one constant, so that the plan is small however many there are."""
        if not self.steps:
            return F.lit(1.0)

        def moved(rate: Column, step: Column) -> Column:
            return F.greatest(F.lit(self.least_rate), rate - sum((p[i] * step[i] for i in range(len(self.steps[0]))), F.lit(0.0)))

        return F.aggregate(F.array(*map(numbers, self.steps)), F.lit(1.0), moved)

    def applied(self, documents: DataFrame) -> DataFrame:
        """``documents`` with mix_tokens, mix_posteriors and mix_rate, from the texts alone."""
        with_x = with_features(documents)
        with_p = with_x.withColumn("mix_s", self.scores(F.col("mix_x"))).withColumn("mix_posteriors", self.posteriors(F.col("mix_s")))
        return with_p.withColumn("mix_rate", self.rate(F.col("mix_posteriors"))).drop("mix_x", "mix_s")


def learned(rows: DataFrame, labels: DataFrame, label: str) -> Mixture:
    """The classifier: moments of the features x in the rows (doc_id, x) of each domain."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("domain"))
    n, x = FEATURES, F.col("x")
    moments = [m for i in range(n) for m in (F.avg(x[i]).alias(f"m{i}"), F.avg(x[i] * x[i]).alias(f"s{i}"))]
    found = rows.join(marked, "doc_id").groupBy("domain").agg(F.count("*").alias("n"), *moments).orderBy("domain").collect()
    total, floor = sum(r["n"] for r in found), 1e-3  # the floor of a variance, where a feature is constant
    return Mixture(
        [r["domain"] for r in found],
        [r["n"] / total for r in found],
        [[r[f"m{i}"] for i in range(n)] for r in found],
        [[max(r[f"s{i}"] - r[f"m{i}"] ** 2, floor) for i in range(n)] for r in found],
    )


def fitted(
    documents: DataFrame,
    labels: DataFrame,
    shares: dict[int, float],
    label: str = "quality",
    total: float | None = None,
    least_rate: float = 0.0,
    rounds: int = 200,
    tolerance: float = 1e-3,
) -> Mixture:
    """The mixture that gives each domain (a value of ``label``) its share of the tokens.

    Domains that ``shares`` doesn't name get none, and domains that no label has
    can't be reached; without any label all documents are one domain. total: all
    tokens of the mixture; if None, the least for which no domain shrinks. Rates
    are at least ``least_rate``. The rounds end where all totals are within
    ``tolerance`` of the mixture's tokens, or where no rate moves any more: then
    the targets can't be met, and these are the least-squares rates. Rates that
    do neither within ``rounds`` raise.
    """
    seen = written(with_features(documents.select("doc_id", "text")).select("doc_id", F.col("mix_tokens").alias("tokens"), F.col("mix_x").alias("x")), "features")
    mixture = replace(learned(seen, labels, label), least_rate=least_rate)
    scored = seen.select("tokens", mixture.scores(F.col("x")).alias("s"))
    rows = written(scored.select("tokens", mixture.posteriors(F.col("s")).alias("p")), "posteriors")
    k = range(max(1, len(mixture.domains)))

    def totals(rate: Column) -> list[float]:
        return list(rows.agg(*(F.coalesce(F.sum(F.col("p")[i] * F.col("tokens") * rate), F.lit(0.0)).alias(f"t{i}") for i in k)).first())

    masses = totals(F.lit(1.0))
    wanted = [shares.get(d, 0.0) for d in mixture.domains] or [1.0]
    if total is None:
        total = max((m / w for m, w in zip(masses, wanted, strict=True) if w > 0), default=sum(masses))
    steps: list[tuple[float, ...]] = []
    last: list[float] | None = None
    for _ in range(rounds):
        errors = [t - w * total for t, w in zip(totals(mixture.rate(F.col("p"))), wanted, strict=True)]
        still = last is not None and max(abs(e - f) for e, f in zip(errors, last, strict=True)) <= 1e-3 * tolerance * total
        if still or max(abs(e) for e in errors) <= tolerance * total:
            return mixture
        last = errors
        steps.append(tuple(e / m if m > 0 else 0.0 for e, m in zip(errors, masses, strict=True)))
        mixture = replace(mixture, steps=tuple(steps))
    raise RuntimeError(f"after {rounds} rounds the domains' totals are still off by {errors} tokens")


def mixed_rates(documents: DataFrame, labels: DataFrame, shares: dict[int, float], **how) -> DataFrame:
    """doc_id, tokens, posteriors, rate of each row of ``documents``; see ``fitted``.

    tokens counts runs between single blanks. Null texts count as empty, with no
    tokens. Rows whose doc_id is null or repeated are rows as others are; an
    empty table gives an empty result; other columns are not read.
    """
    mixture = fitted(documents, labels, shares, **how)
    rows = mixture.applied(documents.select("doc_id", "text"))
    return rows.select("doc_id", F.col("mix_tokens").alias("tokens"), F.col("mix_posteriors").alias("posteriors"), F.col("mix_rate").alias("rate"))


def resampled(documents: DataFrame, mixture: Mixture) -> DataFrame:
    """``documents`` with each row as often as its rate says, the fraction rounded by a hash of text and doc_id."""
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    copies = mixture.applied(documents).withColumn("mix_copies", F.floor(F.col("mix_rate") + chance).cast("int"))
    # Written, so that a row's rate is worked out once, and not again for each use of the number of its copies.
    rows = written(copies.select(*documents.columns, "mix_copies"), "copies")
    return rows.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*documents.columns)
