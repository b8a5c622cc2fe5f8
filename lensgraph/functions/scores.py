"""Scalar rules: bands, divergences, confidences, costs."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarity from which a pair of files falls in each tier, highest first (fixed values).
DUPLICATE_TIERS = ((0.99, "identical"), (0.95, "duplicate"), (0.85, "similar"), (0.75, "related"))
#: Weights of the semantic, structural and behavioral lens (fixed values).
LENS_WEIGHTS = (0.50, 0.25, 0.25)
#: Weights of version, security, compatibility and popularity in an artifact's score (fixed values).
ARTIFACT_WEIGHTS = (0.3, 0.3, 0.2, 0.2)


def band(value: Column, bands: tuple, other: str, strict: bool = False) -> Column:
    """The name of the first band whose threshold the value reaches (or passes, if strict)."""
    out = None
    for least, name in bands:
        test = value > least if strict else value >= least
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def interpretation(score: Column) -> Column:
    """HIGH from 0.7, MEDIUM from 0.3, else LOW; of the raw score, before rounding."""
    return band(score, ((0.7, "HIGH"), (0.3, "MEDIUM")), "LOW")


def divergence(cosine: Column, score: Column) -> Column:
    return cosine - score


def divergence_band(value: Column) -> Column:
    """HIGH above 0.4, MODERATE above 0.2, else LOW."""
    return band(value, ((0.4, "HIGH"), (0.2, "MODERATE")), "LOW", strict=True)


def duplicate_tier(similarity: Column) -> Column:
    return band(similarity, DUPLICATE_TIERS, "distinct")


def drift(similarity: Column) -> tuple[Column, Column]:
    """Drift 1 - sim below 0.7, else null; its severity, HIGH below 0.5, else MEDIUM."""
    return F.when(similarity < 0.7, 1 - similarity), F.when(similarity < 0.5, "HIGH").when(similarity < 0.7, "MEDIUM")


def calibration_action(changed: Column, drifted: Column) -> Column:
    """FULL from a drift above 10 %, else INCREMENTAL with more than 5 changed files, else CACHE with any, else null."""
    return F.when(drifted > 0.1, "FULL").when(changed > 5, "INCREMENTAL").when(changed > 0, "CACHE")


def needs_revalidation(validated: Column, now: Column, days: int) -> Column:
    """Never validated, or more than `days` days ago."""
    return validated.isNull() | (validated < now - F.make_interval(days=F.lit(days)))


def bayes_update(prior: Column, success: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """One outcome: (p a + 1) / (a + b + 1) after a success, p a / (a + b + 1) after a failure."""
    return (prior * alpha + F.when(success, 1.0).otherwise(0.0)) / (alpha + beta + 1)


def bayes_fold(outcomes: Column, prior: float = 0.5) -> Column:
    """bayes_update over an ordered array of booleans."""
    return F.aggregate(outcomes, F.lit(prior), lambda p, ok: bayes_update(p, ok))


def majority_correct(n: int, p: float) -> float:
    """Chance that most of n independent judges, each right with probability p, are right."""
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range((n + 1) // 2, n + 1))


def token_estimate(chars: Column) -> Column:
    """A quarter of the characters of a batch, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / 4))


def embed_cost(files: Column, tokens_per_file: float, per_thousand: float) -> Column:
    return files * F.lit(tokens_per_file) / 1000 * F.lit(per_thousand)


def consensus_pattern(sizes: Column) -> Column:
    """Name of a descending array of group sizes of five judges."""
    return F.concat_ws("-", F.transform(sizes, lambda x: x.cast("string")))
