"""Names of places and areas: keys, area words, and how an area that a text names relates to a city."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words around a city's name that leave it the same place, make it a wider area, or another thing.
SAME_WORDS = ["city", "town", "municipality", "urban"]
WIDER_WORDS = ["greater", "metro", "metropolitan", "area", "region"]
OTHER_WORDS = ["district", "county", "province", "state"]
AREA_WORDS = [*SAME_WORDS, *WIDER_WORDS, *OTHER_WORDS]
NATION_WORDS = ["republic", "of", "the", "kingdom"]
WITHIN = ["in", "of", "within", "across"]


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def key_words(name: Column) -> Column:
    """Words of a place's key: lower case, possessives and signs gone."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "['’]s\\b", ""), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def place_key(name: Column) -> Column:
    return F.array_join(key_words(name), " ")


def core(name: Column, words: list[str] = AREA_WORDS) -> Column:
    """The key without area words."""
    return F.array_join(F.filter(key_words(name), lambda w: ~w.isin(*words)), " ")


def mentions(text: Column, name: Column) -> Column:
    """Whether a name stands in a text as whole words."""
    return (place_key(name) != "") & F.contains(F.concat(F.lit(" "), place_key(text), F.lit(" ")), F.concat(F.lit(" "), place_key(name), F.lit(" ")))


def same_name(label: Column, name: Column, words: list[str]) -> Column:
    """Equal after taking out generic words, never by containment."""
    return (core(name, words) != "") & (core(label, words) == core(name, words))


def country_code(label: Column, country: Column) -> Column:
    """Whether a label is the initials of a country's name."""
    letters = F.array_join(F.transform(F.filter(key_words(country), lambda w: ~w.isin("of", "the", "and")), lambda w: F.substring(w, 1, 1)), "")
    bare = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    return (F.length(letters) > 1) & (bare == letters)


def word_class(removed: Column) -> Column:
    """same, wider or other, by the area words around a name; null if one of them is no area word."""
    return (
        F.when(F.size(F.array_except(removed, _list(AREA_WORDS))) > 0, F.lit(None).cast("string"))
        .when(F.arrays_overlap(removed, _list(OTHER_WORDS)), "other").when(F.arrays_overlap(removed, _list(WIDER_WORDS)), "wider").otherwise("same")
    )


def city_fit(level: Column, words: Column) -> Column:
    """Relation of an area with the city's name: inside levels are the city itself, wider words contain it."""
    inside = (words == "same") & level.isin("city_wide", "sub_city_area", "sub_city_population")
    return F.when(words.isNull() | (words == "other"), "unresolved").when(inside, "city").otherwise("contains_city")


def within_city(label_key: Column, name_key: Column) -> Column:
    """The key ends in `in|of|within|across [the] name [city]` after other words."""
    out = F.lit(False)
    for p in WITHIN:
        for tail in (F.concat(F.lit(f" {p} "), name_key), F.concat(F.lit(f" {p} the "), name_key), F.concat(F.lit(f" {p} "), name_key, F.lit(" city"))):
            out = out | (label_key.endswith(tail) & (F.length(label_key) > F.length(tail)))
    return out


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * 6371)


def looks_like_name(name: Column) -> Column:
    """Alternate names worth keeping: five letters or more, a capital first, not all capitals, only letters and . ' - and blanks."""
    return (F.length(name) >= 5) & name.rlike(r"^\p{Lu}[\p{L} .'-]*$") & (name != F.upper(name))
