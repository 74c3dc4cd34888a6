"""Scope maps: year, territory, origin; access classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DATA_CLASSES
from .units import lookup

# Territory spellings.
GEOGRAPHY_ALIASES = {
    "ru": "россия", "rf": "россия", "russia": "россия", "россия": "россия", "su": "россия", "sssr": "россия",
    "kz": "казахстан", "kazakhstan": "казахстан", "uz": "узбекистан",
}


def documented_year(scope: Column) -> Column:
    """The documented year when it is a number from 1800 to 2100; anything else is unknown."""
    year = F.try_element_at(scope, F.lit("year")).try_cast("int")
    return F.when(year.between(1800, 2100), year)


def documented_geography(scope: Column) -> Column:
    value = F.trim(F.try_element_at(scope, F.lit("geography")))
    return F.when(value != "", value)


def normalize_geography(col: Column) -> Column:
    plain = F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " ")
    plain = F.trim(F.regexp_replace(F.translate(plain, "ё", "е"), " +", " "))
    return F.coalesce(lookup(GEOGRAPHY_ALIASES, plain), plain)


def geography_matches(value: Column, wanted: Column) -> Column:
    """Substring in either direction, whole or per word; wanted names under two characters are ignored."""
    haystack = normalize_geography(value)
    tokens = F.filter(F.split(haystack, " "), lambda t: t != "")

    def one(mention: Column) -> Column:
        needle = normalize_geography(mention)
        return (F.length(needle) >= 2) & (
            haystack.contains(needle) | F.exists(tokens, lambda t: t.contains(needle) | needle.contains(t))
        )

    return F.exists(wanted, one)


def is_demo(scope: Column) -> Column:
    return F.coalesce(F.try_element_at(scope, F.lit("origin")) == "demo", F.lit(False))


def shared_scope(left: Column, right: Column) -> Column:
    """Keys both maps carry, as sorted (key, value) pairs of the left map."""
    both = F.map_filter(left, lambda k, v: F.map_contains_key(right, k))
    return F.array_sort(F.map_entries(both))


def scope_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def scopes_agree(left: Column, right: Column) -> Column:
    """Equal values on every key both maps carry."""
    return F.forall(
        F.map_keys(left),
        lambda k: ~F.map_contains_key(right, k) | (F.try_element_at(left, k) == F.try_element_at(right, k)),
    )


def scope_items(scope: Column) -> Column:
    return F.array_sort(F.map_entries(scope))


def class_rank(col: Column) -> Column:
    return lookup({name: i for i, name in enumerate(DATA_CLASSES)}, col)


def max_class(classes: Column) -> Column:
    """The most protected class of an array."""
    top = F.array_max(F.transform(classes, class_rank))
    return lookup(dict(enumerate(DATA_CLASSES)), top)


def allowed(col: Column, classes) -> Column:
    """Access rule: ``None`` allows every class, an empty set allows none."""
    if classes is None:
        return F.lit(True)
    return col.isin(*sorted(classes)) if classes else F.lit(False)
