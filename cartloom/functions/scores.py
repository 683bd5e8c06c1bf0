"""Scores of anchors, add-ons and add-on pairs as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.functions.text import contains_any, normalise_query, query_words


@dataclass(frozen=True)
class AnchorWeights:
    """Weights of :func:`anchor_score`."""

    units: float = fixed.ANCHOR_UNITS
    rate: float = fixed.ANCHOR_RATE
    name_chars: float = fixed.ANCHOR_NAME_CHARS
    exact: float = fixed.ANCHOR_EXACT
    plural: float = fixed.ANCHOR_PLURAL
    prefix: float = fixed.ANCHOR_PREFIX
    penalty: float = fixed.ANCHOR_PENALTY
    penalty_words: Sequence[str] = fixed.ANCHOR_PENALTY_WORDS


@dataclass(frozen=True)
class AddonWeights:
    """Weights of :func:`addon_score` and of the pair synergy."""

    count: float = fixed.ADDON_COUNT
    rate: float = fixed.ADDON_RATE
    units_cap: int = fixed.ADDON_UNITS_CAP
    units_divisor: float = fixed.ADDON_UNITS_DIVISOR
    same_department: float = fixed.ADDON_SAME_DEPARTMENT
    penalty: float = fixed.ADDON_PENALTY
    penalty_word: str = fixed.ADDON_PENALTY_WORD
    exempt_words: Sequence[str] = fixed.ADDON_PENALTY_EXEMPT
    synergy: float = fixed.PAIR_SYNERGY


def anchor_score(
    query: Column,
    name: Column,
    units: Column,
    rate: Column,
    weights: AnchorWeights = AnchorWeights(),
) -> Column:
    """How well a product serves as the anchor for a query."""
    asked = normalise_query(query)
    lowered = F.lower(name)
    single = F.size(query_words(query)) == 1

    def bonus(condition: Column, points: float) -> Column:
        return F.when(single & condition, F.lit(points)).otherwise(F.lit(0.0))

    score = (
        units * F.lit(weights.units)
        + rate * F.lit(weights.rate)
        - F.length(name) * F.lit(weights.name_chars)
        + bonus(lowered == asked, weights.exact)
        + bonus(lowered == F.concat(asked, F.lit("s")), weights.plural)
        + bonus(F.startswith(lowered, F.concat(asked, F.lit(" "))), weights.prefix)
    )
    for word in weights.penalty_words:
        score = score - F.when(F.contains(lowered, F.lit(word)), weights.penalty).otherwise(0.0)
    return score


def penalty_exempt(query: Column, weights: AddonWeights = AddonWeights()) -> Column:
    """Whether the query lifts the penalty on add-ons with the penalty word."""
    return contains_any(F.lower(query), weights.exempt_words)


def addon_score(
    count: Column,
    rate: Column,
    units: Column,
    department_id: Column,
    anchor_department_id: Column,
    name: Column,
    exempt: Column,
    weights: AddonWeights = AddonWeights(),
) -> Column:
    """How well a candidate fits the anchor; two missing departments count as the same."""
    return (
        count * F.lit(weights.count)
        + rate * F.lit(weights.rate)
        + F.least(units, F.lit(weights.units_cap)) / F.lit(weights.units_divisor)
        + F.when(
            department_id.eqNullSafe(anchor_department_id), F.lit(weights.same_department)
        ).otherwise(F.lit(0.0))
        - F.when(
            F.contains(F.lower(name), F.lit(weights.penalty_word)) & ~exempt, F.lit(weights.penalty)
        ).otherwise(F.lit(0.0))
    )
