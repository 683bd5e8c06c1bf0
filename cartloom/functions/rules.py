"""Promotion rules as Column expressions over a bundle's numbers and names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Row, functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.functions.text import contains_any, first_match


@dataclass(frozen=True)
class Cuts:
    """Cut-offs for offers, confidence and impact; the defaults suit counts in the ten thousands."""

    discount: Sequence[tuple[float, str]] = fixed.DISCOUNT_STEPS
    discount_default: str = fixed.DISCOUNT_DEFAULT
    confidence: Sequence[tuple[float, str]] = fixed.CONFIDENCE_STEPS
    confidence_default: str = fixed.CONFIDENCE_DEFAULT
    trial_rate: float = fixed.TRIAL_RATE
    basket_affinity: float = fixed.BASKET_AFFINITY
    basket_units: float = fixed.BASKET_UNITS
    attach_affinity: float = fixed.ATTACH_AFFINITY

    @classmethod
    def from_row(cls, row: Row) -> Cuts:
        """Cut-offs from the one row of :func:`cartloom.operators.features.calibrate`."""
        texts = [text for _, text in fixed.DISCOUNT_STEPS]
        levels = [text for _, text in fixed.CONFIDENCE_STEPS]
        return cls(
            discount=tuple(zip((row.affinity_high, row.affinity_mid, row.affinity_low), texts)),
            confidence=tuple(zip((row.affinity_high, row.affinity_mid), levels)),
            trial_rate=row.rate_low,
            basket_affinity=row.affinity_high,
            basket_units=row.units_mid,
            attach_affinity=row.affinity_mid,
        )


def step(value: Column, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """The text of the first step that ``value`` reaches."""
    return first_match([(value >= cut, F.lit(text)) for cut, text in steps], F.lit(default))


def discount(min_affinity: Column, cuts: Cuts = Cuts()) -> Column:
    """The stronger the natural pairing, the smaller the discount."""
    return step(min_affinity, cuts.discount, cuts.discount_default)


def confidence(min_affinity: Column, cuts: Cuts = Cuts()) -> Column:
    """High, Medium or Low."""
    return step(min_affinity, cuts.confidence, cuts.confidence_default)


def expected_impact(
    rate: Column, units: Column, min_affinity: Column, cuts: Cuts = Cuts()
) -> Column:
    """What the promotion is expected to do; a low reorder rate decides first."""
    rate, units = F.coalesce(rate, F.lit(0.0)), F.coalesce(units, F.lit(0))
    return first_match(
        [
            (rate < cuts.trial_rate, F.lit(fixed.IMPACT_TRIAL)),
            (
                (min_affinity >= cuts.basket_affinity) & (units >= cuts.basket_units),
                F.lit(fixed.IMPACT_BASKET),
            ),
            (min_affinity >= cuts.attach_affinity, F.lit(fixed.IMPACT_ATTACH)),
        ],
        F.lit(fixed.IMPACT_DISCOVERY),
    )


def offer(rate: Column, units: Column, min_affinity: Column, cuts: Cuts = Cuts()) -> Column:
    """The offer text with the discount of the pair."""
    rate, units = F.coalesce(rate, F.lit(0.0)), F.coalesce(units, F.lit(0))
    saving = discount(min_affinity, cuts)
    return first_match(
        [
            (rate < cuts.trial_rate, F.lit(fixed.OFFER_TRIAL)),
            (units >= cuts.basket_units, F.concat(F.lit(fixed.OFFER_TWO), saving)),
        ],
        F.concat(F.lit(fixed.OFFER_ONE), saving),
    )


def theme(
    anchor_name: Column,
    item_names: Column,
    rules: Sequence[tuple[str, Sequence[str], str]] = fixed.THEME_RULES,
    default: str = fixed.THEME_DEFAULT,
) -> Column:
    """The theme of a bundle from its anchor's name and the array of its items' names."""
    places = {
        "anchor": F.lower(F.coalesce(anchor_name, F.lit(""))),
        "items": F.lower(F.array_join(F.filter(item_names, lambda name: name != ""), " ")),
    }
    return first_match(
        [(contains_any(places[place], words), F.lit(text)) for place, words, text in rules],
        F.lit(default),
    )


def placement(
    theme_text: Column,
    rules: Sequence[tuple[Sequence[str], Sequence[str]]] = fixed.PLACEMENT_RULES,
    default: Sequence[str] = fixed.PLACEMENT_DEFAULT,
) -> Column:
    """Where to show the promotion, as an array, from words of the theme."""
    lowered = F.lower(theme_text)
    return first_match(
        [(contains_any(lowered, words), F.array(*map(F.lit, spots))) for words, spots in rules],
        F.array(*map(F.lit, default)),
    )
