"""Explainable scores and badges as CASE expressions over a parameter object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreParams:
    """Cut points of the confidence label, and the ages that make a fact outdated."""

    high: int = 7
    medium: int = 4
    outdated_years: int = 5


def confidence(points: Column, capped: Column, params: ScoreParams) -> Column:
    """High, Medium or Low; a capped fact is Medium at most."""
    label = F.when(points >= params.high, "High").when(points >= params.medium, "Medium").otherwise("Low")
    return F.when(capped & (label == "High"), "Medium").otherwise(label)


def main_badge(*badges: tuple[str, Column]) -> Column:
    """The first (most severe) badge whose condition holds, else null."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in badges])


def other_badges(*badges: tuple[str, Column]) -> Column:
    """The badges after the main one, in order, joined by commas."""
    held = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in badges]))
    return F.array_join(F.slice(held, 2, len(badges)), ",")


def weighted_rank(ordinals: dict[str, int], value: Column) -> Column:
    """Ordinal of a closed vocabulary; unknown values come last."""
    out = F.lit(len(ordinals))
    for word, place in ordinals.items():
        out = F.when(value == word, place).otherwise(out)
    return out
