"""Which value of a decoded record names its type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from flowsift.functions.text import _column, bind, strip

# Fall-back fields, display fields, spellings of "no type".
FALLBACK_FIELDS = ["label", "category", "class"]
DISPLAY_FIELDS = ["type", "label", "category", "class", "attack_cat", "attack_cat_", "Attack_cat"]
NO_TYPE = ["none", "null", "nan", "", "undefined"]


def _equals(text: str) -> Callable[[Column], Column]:
    return lambda c: c == text


def _first(entries: Column, wanted: Callable[[Column], Column]) -> Column:
    """First (key, value) in document order whose lower-case key is wanted."""
    return F.get(F.filter(entries, lambda e: wanted(F.lower(e["key"]))), 0)


def type_of(data="data", row_type=None) -> Column:
    """Value of the first `type` key, else of the first fall-back key; case-insensitive.

    `row_type` is an optional last resort outside the document.
    """

    def pick(entries: Column) -> Column:
        named = _first(entries, lambda k: k == "type")["value"]
        return F.coalesce(named, _first(entries, lambda k: k.isin(FALLBACK_FIELDS))["value"])

    found = bind(F.map_entries(_column(data)), pick)
    return found if row_type is None else F.coalesce(found, _column(row_type))


def display_type_of(data="data") -> Column:
    """Type shown in a grid: fields are tried in list order, '-' when none answers.

    An exact, non-empty field ends the search; so does a field found in another case,
    unless it says '-'. A null found that way reads 'null'.
    """
    lowered = sorted({f.lower() for f in DISPLAY_FIELDS})

    def pick(entries: Column) -> Column:
        found = []
        for field in DISPLAY_FIELDS:
            exact = F.get(F.filter(entries, lambda e: _equals(field)(e["key"])), 0)["value"]
            entry = _first(entries, _equals(field.lower()))
            loose = F.when(entry.isNotNull(), strip(F.coalesce(entry["value"], F.lit("null"))))
            found.append(F.when(exact != "", strip(exact)).otherwise(F.nullif(loose, F.lit("-"))))
        return F.coalesce(F.nullif(F.coalesce(*found), F.lit("")), F.lit("-"))

    known = F.filter(F.map_entries(_column(data)), lambda e: F.lower(e["key"]).isin(lowered))
    return F.coalesce(bind(known, pick), F.lit("-"))


def normalise_type(value) -> Column:
    return bind(strip(_column(value)), lambda text: F.when(~F.lower(text).isin(NO_TYPE), text))
