"""Scores, tiers and keyword classes as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

# Weights of the composite score (own score, similarity, hard fact, tribunal; and the vote-mismatch form).
WEIGHTS = {"nli": 0.35, "similarity": 0.20, "hard_fact": 0.15, "tribunal": 0.30}
VOTE_WEIGHTS = {"nli": 0.15, "similarity": 0.10, "quality": 0.10, "hard_fact": 0.40, "tribunal": 0.25}
# Lower bounds of tiers, bands and labels.
TIERS = ((0.95, "PUBLISHED"), (0.80, "CONTEXT_DEVELOPMENT"))
BANDS = ((0.95, "very high"), (0.85, "high"), (0.80, "moderate"))
LABELS = ((0.95, "consistent"), (0.85, "mostly consistent"), (0.70, "mixed"))


def composite_score(weights: dict[str, float], **signals: Column) -> Column:
    """Weighted mean of signals in [0, 1]; a null signal counts 0.5, a boolean 1 or 0."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    total = sum(weights.values())
    terms = [F.lit(w) * clamp(F.coalesce(signals[k].cast("double"), F.lit(0.5))) for k, w in weights.items()]
    return clamp(sum(terms[1:], terms[0]) / F.lit(total))


def banded(score: Column, bands: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first band whose lower bound the score reaches; rest below all, and for null."""
    out = None
    for low, name in bands:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out.otherwise(rest)


def presentation_tier(score: Column) -> Column:
    return banded(score, TIERS, "DROPPED")


def confidence_band(score: Column) -> Column:
    return banded(score, BANDS, "low")


def index_label(score: Column) -> Column:
    return banded(score, LABELS, "inconsistent")


def consistency_index(n: Column, high: Column) -> Column:
    """1 without commitments, else 1 - high / n, clamped to [0, 1], four digits."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - high / n))
    return F.round(F.when(n <= 0, F.lit(1.0)).otherwise(share), 4)


def any_of(words: Sequence[str]) -> str:
    """A regular expression for any of some phrases."""
    return "|".join(re.escape(w) for w in words)


def keyword_class(text: Column, classes: Sequence[tuple[str, Sequence[str]]], rest: str) -> Column:
    """The first class one of whose phrases the lower-cased text holds, else rest (also for null)."""
    low = F.lower(text)
    out = None
    for name, words in classes:
        hit = F.regexp_like(low, F.lit(any_of(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(rest)


def flip_attribution(text: Column, evidence: Column, mismatch: Column, score: Column, shock: Sequence[str] = R.SHOCK_WORDS, coalition: Sequence[str] = R.COALITION_WORDS, evasion: Sequence[str] = R.EVASION_WORDS) -> Column:
    """Why a position changed: an external shock needs evidence, else the next class is tried."""
    low = F.lower(text)
    has = lambda words: F.coalesce(F.regexp_like(low, F.lit(any_of(words))), F.lit(False))
    return (
        F.when(has(shock) & F.coalesce(evidence, F.lit(False)), "EXTERNAL_SHOCK").when(has(coalition), "COALITION_COMPROMISE")
        .when((mismatch & (score < 0.82)) | has(evasion), "PROCEDURAL_EVASION").otherwise("OPPORTUNISTIC_FLIP")
    )


def argmax_label(probabilities: dict[str, Column], rest: str = "NEUTRAL") -> Column:
    """The name of the largest probability (ties: the first named), rest where all are null."""
    best = F.greatest(*probabilities.values())
    out = None
    for name, p in probabilities.items():
        out = F.when(p == best, name) if out is None else out.when(p == best, name)
    return out.otherwise(rest)


def mismatch_reason(kind: Column, said: Column, did: Column) -> Column:
    """Why a statement and a vote do or do not disagree."""
    return (
        F.when(kind == "PROCEDURAL", "procedural vote").when(said.isNull() | did.isNull(), "side missing")
        .when(F.upper(F.trim(said)) == F.upper(F.trim(did)), "agrees").otherwise("mismatch")
    )


def applied_verdict(dismissed: Column, passed: Column, downgrade: Column, kind: Column, severity: Column, score: Column, override: Column) -> Column:
    """Struct of kept, kind, severity, score and downgraded_from after a verdict.

    Dismissed, or not passed without a usable downgrade: dropped. A downgrade to another kind
    changes it and makes the severity MEDIUM. An override of the score wins where present.
    """
    usable = downgrade.isNotNull() & (downgrade != kind)
    kept = ~F.coalesce(dismissed, F.lit(False)) & (F.coalesce(passed, F.lit(True)) | downgrade.isNotNull())
    return F.struct(
        kept.alias("kept"),
        F.when(usable, downgrade).otherwise(kind).alias("kind"),
        F.when(usable, "MEDIUM").otherwise(severity).alias("severity"),
        F.coalesce(override, score).alias("score"),
        F.when(usable, kind).alias("downgraded_from"),
    )


def divergence_warning(passed: Column, defences: Column) -> Column:
    """Passed with fewer than two defences, or with identical ones."""
    return F.coalesce(passed, F.lit(False)) & ((F.size(defences) < 2) | (F.size(F.array_distinct(defences)) < F.size(defences)))
