"""JSON text of the log -> map of texts in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.functions.text import bind

JSON_MAP = "map<string,string>"
# Single quotes are not JSON; Spark accepts them unless told otherwise.
JSON_OPTIONS = {"allowSingleQuotes": "false"}


def parse_document(c) -> Column:
    """Map of an object, null for anything that is not one. The last of equal keys wins.

    The text is read as the first element of a list that ends with a sentinel object, so
    that anything after the object makes the list longer or unreadable.
    """
    text = F.col(c) if isinstance(c, str) else c
    mark = F.md5(text.cast("binary"))
    listed = F.concat(F.lit("["), text, F.lit(',{"'), mark, F.lit('":""}]'))
    elements = F.from_json(listed, f"array<{JSON_MAP}>", JSON_OPTIONS)
    alone = lambda e: F.when((F.size(e) == 2) & F.map_contains_key(F.get(e, 1), mark), F.get(e, 0))
    parsed = bind(elements, alone)

    def last_wins(m: Column) -> Column:
        keys = F.array_distinct(F.map_keys(m))
        last = lambda k: F.element_at(F.filter(F.map_entries(m), lambda e: e["key"] == k), -1)
        once = F.map_from_arrays(keys, F.transform(keys, lambda k: last(k)["value"]))
        return F.when(F.size(keys) < F.size(m), once).otherwise(m)

    return bind(parsed, last_wins)


def decode_records(rec: DataFrame, on_error: str = "keep") -> DataFrame:
    """Replace row_data by `data`; an unreadable row becomes an error document or is left out."""
    others = [c for c in rec.columns if c != "row_data"]
    parsed = parse_document("row_data")
    if on_error == "keep":
        # The error text is a fixed value.
        broken = F.create_map(
            F.lit("error"), F.lit("Failed to parse row data"), F.lit("raw"), F.col("row_data")
        )
        return rec.select(*others, F.coalesce(parsed, broken).alias("data"))
    if on_error == "skip":
        # A generator, not a filter: the optimiser would repeat the parse inside a filter.
        return rec.select(*others, F.explode(F.array_compact(F.array(parsed))).alias("data"))
    raise ValueError("on_error must be 'keep' or 'skip'")
