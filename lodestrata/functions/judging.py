"""Ranking key, badges, confidence and comparability of claims, as expressions over columns named as in `sources.claims`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.sources import claims as C


@dataclass(frozen=True)
class Policy:
    """Accepted levels, ages in years, sizes and tolerances that the rules take as parameters."""

    accepted: tuple[str, ...] = ("city_wide", "sub_city_population")
    recent_years: int = 5
    stale_years: int = 5
    stale_years_people: int = 2
    small_sample: int = 300
    high: int = 7
    medium: int = 4
    agree_points: int = 50
    agree_share: float = 0.02
    proxy_months: int = 12


#: Ranks and points of the vocabularies, and settings that reach only part of a population.
TIER = {"government": 0, "multilateral": 0, "academic": 1, "ngo": 2, "news": 3, "other": 4}
TIER_POINTS = {"government": 2, "multilateral": 2, "academic": 2, "ngo": 1}
SAMPLING_RANK = {"census": 0, "representative_sample": 1, "modelled": 2, "not_stated": 3, "not_applicable": 3, "non_representative": 4}
SAMPLING_POINTS = {"census": 2, "representative_sample": 2, "modelled": 1, "not_stated": 1, "not_applicable": 1}
NARROW_SETTINGS = ("facility", "school", "workplace")
NEED_DENOMINATOR = ("measured_prevalence", "self_reported_prevalence", "screening_positivity", "cascade_awareness")


def looked_up(value: Column, table: dict[str, int], default: int | None = 0) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), value), F.lit(default))


def ordinal(level: Column) -> Column:
    return looked_up(level, {name: i for i, name in enumerate(C.LEVELS)}, None)


def effective_level(level: Column, fit: Column, fit_level: Column) -> Column:
    """The level a claim counts as: near places at least a district, containing areas at least a metro region."""

    def at_least(name: str) -> Column:
        return F.when(ordinal(level) < C.LEVELS.index(name), F.lit(name)).otherwise(level)

    wide = ordinal(level) >= C.LEVELS.index("metro_region")
    city = F.coalesce(fit_level, F.when(wide, F.lit("city_wide")).otherwise(level))
    return F.when(fit == "nearby", at_least("district")).when(fit == "contains_city", at_least("metro_region")).when(fit == "city", city).otherwise(level)


def geography_distance(level: Column, accepted: Sequence[str]) -> Column:
    """Steps to the nearest accepted level, 0 if it is one."""
    return F.least(*[F.abs(ordinal(level) - C.LEVELS.index(a)) for a in accepted]) if len(accepted) > 1 else F.abs(ordinal(level) - C.LEVELS.index(accepted[0]))


def own_level() -> Column:
    return effective_level(F.col("level"), F.col("fit"), F.col("fit_level"))


def rank_key(policy: Policy) -> list[Column]:
    """Ascending: distance of geography, source tier, sampling, undated last, newest first, id."""
    return [
        geography_distance(own_level(), policy.accepted), looked_up(F.col("publisher"), TIER), looked_up(F.col("sampling"), SAMPLING_RANK),
        F.col("ref_end").isNull(), F.col("ref_end").desc(), F.col("claim_id"),
    ]


def years_before(day: Column, years: int) -> Column:
    """The same day so many years earlier; 29 February becomes the 28th."""
    return F.add_months(day, -12 * years)


def badges(today: Column, policy: Policy) -> list[tuple[str, Column]]:
    """(badge, whether it holds), most severe first."""
    wide = ~own_level().isin(*policy.accepted) | F.col("subgroup").isNotNull() | F.coalesce(F.col("setting").isin(*NARROW_SETTINGS), F.lit(False))
    age = F.when(F.col("kind") != "relation", F.col("ref_end") < years_before(today, policy.stale_years)).when(F.col("relation") == "LEADS", F.col("ref_end") < years_before(today, policy.stale_years_people))
    small = (F.col("sampling") == "non_representative") | F.coalesce(F.col("sample_size") < policy.small_sample, F.lit(False))
    return [("not_city_level", wide), ("sources_disagree", F.col("status") == "contested"), ("outdated", F.coalesce(age, F.lit(False))), ("limited_sample", small)]


def score_parts(today: Column, policy: Policy) -> list[tuple[str, Column]]:
    """(component, points) of the confidence score, nine at most together."""
    fits = own_level().isin(*policy.accepted)
    recent = F.coalesce(F.col("ref_end") >= years_before(today, policy.recent_years), F.lit(False))
    denominator = F.col("denominator_stated") | ~F.col("measure").isin(*NEED_DENOMINATOR)
    return [
        ("source_tier", looked_up(F.col("publisher"), TIER_POINTS)), ("sampling", looked_up(F.col("sampling"), SAMPLING_POINTS)), ("geography", F.when(fits, 2).otherwise(0)),
        ("recency", recent.cast("int")), ("denominator", denominator.cast("int")), ("verdict", F.col("scope_verified").cast("int")),
    ]


def points(today: Column, policy: Policy) -> Column:
    parts = [p for _, p in score_parts(today, policy)]
    return sum(parts[1:], parts[0]).cast("int")


def label(points_: Column, policy: Policy) -> Column:
    """High, Medium or Low; High needs a first-choice checker and a stated period."""
    plain = F.when(points_ >= policy.high, "High").when(points_ >= policy.medium, "Medium").otherwise("Low")
    capped = F.col("fallback") | F.col("proxy") | F.col("ref_end").isNull()
    return F.when(capped & (plain == "High"), "Medium").otherwise(plain)


KEY_PARTS = ("indicator", "measure", "unit", "sex", "age_min", "level", "setting", "subgroup")


def key_gaps() -> Column:
    """Reasons why a figure can't be compared with any other, in order; empty if it can."""
    gaps = {"value not parsed": F.col("hundredths").isNull(), "ages not stated": F.col("age_min").isNull(), "sex not stated": F.col("sex") == "not_stated", "setting not stated": F.col("setting") == "not_stated"}
    return F.array_compact(F.array(*[F.when(held, F.lit(name)) for name, held in gaps.items()]))


def comparability_key() -> Column:
    """The eight parts joined by bars, null where a part is missing."""
    parts = [F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in KEY_PARTS]
    return F.when(F.size(key_gaps()) == 0, F.concat_ws("|", *parts))


def differing_parts(a: str, b: str) -> Column:
    """Names of the key parts in which two claims (structs) differ, in order."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{a}.{p}").eqNullSafe(F.col(f"{b}.{p}")), F.lit(p)) for p in KEY_PARTS]))


def periods_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, unknown: Column) -> Column:
    """Closed intervals meet; an unknown period or a proxy meets every other."""
    missing = unknown | F.coalesce(a_start, a_end).isNull() | F.coalesce(b_start, b_end).isNull()
    return missing | ((F.coalesce(a_start, a_end) <= F.coalesce(b_end, b_start)) & (F.coalesce(b_start, b_end) <= F.coalesce(a_end, a_start)))


def values_agree(a: Column, b: Column, percent: Column, policy: Policy) -> Column:
    """In hundredths: half a point for percentages, else a share of the larger."""
    gap, largest = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    return F.when(percent, gap <= policy.agree_points).otherwise((largest == 0) | (gap <= largest * F.lit(policy.agree_share)))


def agreeing_values(value: Column, percent: Column, policy: Policy) -> tuple[Column, Column]:
    """The least and the most figure, in hundredths, with which one agrees: `values_agree` as bounds.

    With a share p of the larger of two, others agree from (1 - p) of a figure to 1 / (1 - p) of it; of one below zero
    it is the other way round, and zero agrees with zero alone.
    """
    share = F.lit(1.0 - policy.agree_share)
    inner, outer = value * share, value / share
    low = F.when(percent, value - policy.agree_points).otherwise(F.least(inner, outer))
    high = F.when(percent, value + policy.agree_points).otherwise(F.greatest(inner, outer))
    return low, high


def months_apart(a: Column, b: Column) -> Column:
    """Whole months between two days, whichever is earlier."""
    early, late = F.least(a, b), F.greatest(a, b)
    return (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early) - (F.dayofmonth(late) < F.dayofmonth(early)).cast("int")


def succession(new: str, old: str, policy: Policy) -> Column:
    """supersede, history or conflict of two claims (structs) for one place, by what is known of their validity.

    Each is a period with open ends. Where one has ended by the time the other begins, they are in that order. Otherwise
    years of begin order them, if both are known, no end reaches past the other's begin, and no begin that was taken from
    a date of publication is within the months that such a date may be off.
    """
    begin, end = {x: F.col(f"{x}.valid_from") for x in (new, old)}, {x: F.col(f"{x}.valid_to") for x in (new, old)}
    ended = lambda x, y: F.coalesce(end[x] <= begin[y], F.lit(False))
    reaches = lambda x, y: F.coalesce(end[x] > begin[y], F.lit(False))
    proxy = F.col(f"{new}.from_proxy") | F.col(f"{old}.from_proxy")
    unsure = proxy & (months_apart(begin[new], begin[old]) <= policy.proxy_months)
    told = begin[new].isNotNull() & begin[old].isNotNull() & ~unsure & ~reaches(old, new) & ~reaches(new, old)
    years = F.when(told, F.signum((F.year(begin[new]) - F.year(begin[old])).cast("double")))
    later = F.when(ended(old, new), 1.0).when(ended(new, old), -1.0).otherwise(F.coalesce(years, F.lit(0.0)))
    return F.element_at(F.array(F.lit("history"), F.lit("conflict"), F.lit("supersede")), (later + 2).cast("int"))
