"""Confidence in merged fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of fields in the overall confidence, in order; all others weigh 1.
WEIGHTS: dict[str, float] = {
    "emails": 1.5, "phones": 1.2, "full_name": 1.5, "headline": 1.0, "years_experience": 1.0,
    "location": 1.0, "links": 1.0, "skills": 1.0, "experience": 1.0, "education": 0.8,
}


def round3(x: Column) -> Column:
    """Three decimals, to the nearest, halves of the exact binary value to even.

    The product with 1000 is followed exactly: the number is split into two
    halves of its bits (Dekker), whose products are exact.  The number is bound
    once, so that expressions over expressions don't multiply.
    """
    return F.get(F.transform(F.array(x), _nearest), F.lit(0))


def _nearest(x: Column) -> Column:
    k = F.floor(x * F.lit(1000.0))
    high = (x * F.lit(134217729.0)) - ((x * F.lit(134217729.0)) - x)
    d = ((high * F.lit(1000.0)) - (k + F.lit(0.5))) + ((x - high) * F.lit(1000.0))
    return F.when((d > 0) | ((d == 0) & (k % 2 == 1)), k + 1).otherwise(k) / F.lit(1000.0)


def agreement(n_agree: Column, n_conflict: Column | int = 0) -> Column:
    """More than 1 where sources agree, less where they conflict; from 0.6 to 1.15."""
    conflict = F.lit(n_conflict) if isinstance(n_conflict, int) else n_conflict
    raw = F.lit(1.0) + F.lit(0.08) * F.greatest(n_agree - 1, F.lit(0)) - F.lit(0.18) * conflict
    return F.greatest(F.lit(0.6), F.least(F.lit(1.15), raw))


def completeness(n_present: Column, n_parts: int) -> Column:
    """From 0.5 to 1 with the share of parts that are there."""
    return F.lit(0.5) + F.lit(0.5) * (n_present / F.lit(float(n_parts)))


def field_confidence(trust: Column, n_agree: Column, n_conflict: Column | int = 0, complete: Column | None = None) -> Column:
    """Trust times agreement times completeness, within 0 and 1, to three decimals."""
    score = trust * agreement(n_agree, n_conflict) * (F.lit(1.0) if complete is None else complete)
    return round3(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def mean3(values: Column) -> Column:
    """The mean of an array, added up in its order, to three decimals."""
    return round3(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def overall_confidence(confidences: dict[str, Column]) -> Column:
    """The weighted mean over fields with a confidence, in the order of WEIGHTS; 0 if there are none."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.items():
        c = confidences[name]
        total = total + F.coalesce(F.lit(w) * c, F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(weight > 0, round3(total / weight)).otherwise(F.lit(0.0))
