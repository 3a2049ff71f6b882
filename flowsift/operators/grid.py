"""Operators of the record grid: flatten, search, slice, typed-in lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from flowsift.functions import strip
from flowsift.operators.position import dense_position, key_range


def flatten_records(m: DataFrame) -> DataFrame:
    """Add `row`: id, the document, then upload_timestamp and T where present.

    A key `id` of the document wins over the row id; upload_timestamp and T of the
    row win over the document.
    """
    ts, split = F.col("upload_timestamp"), F.col("T")
    after = F.map_filter(
        F.create_map(F.lit("upload_timestamp"), ts.cast("string"), F.lit("T"), split),
        lambda _, v: v.isNotNull(),
    )
    before = F.when(
        ~F.map_contains_key("data", F.lit("id")), F.create_map(F.lit("id"), F.col("id").cast("string"))
    ).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    taken = lambda k: ((k == "upload_timestamp") & ts.isNotNull()) | ((k == "T") & split.isNotNull())
    middle = F.map_filter("data", lambda k, _: ~taken(k))
    return m.withColumn("row", F.map_concat(before, middle, after))


def search_any(m: DataFrame, query: str, col: str = "data") -> DataFrame:
    """Rows where any value contains the query, case ignored. A null value never matches."""
    wanted = F.lit(query.lower())
    return m.where(F.exists(F.map_values(col), lambda v: F.coalesce(F.contains(F.lower(v), wanted), F.lit(False))))


def positional_slice(df: DataFrame, part: str, frac: float = 0.8, order_col: str = "id") -> DataFrame:
    """First ceil(frac * n) rows by position ('training') or the rest ('testing')."""
    if part not in ("training", "testing"):
        raise ValueError("part must be 'training' or 'testing'")
    span = key_range(df, F.col(order_col))
    cut = math.ceil(span.rows * frac)
    placed = dense_position(df, order_col, name="_position", span=span)
    inside = F.col("_position") <= cut
    return placed.where(inside if part == "training" else ~inside).drop("_position")


def parse_lines(df: DataFrame, line_col: str, columns: list[str]) -> DataFrame:
    """Add `data` from a comma-separated line by position; `error` where parts are missing.

    No quoting; surplus parts are ignored.
    """
    parts = F.transform(F.split(strip(line_col), ",", -1), strip)
    enough = (strip(line_col) != "") & (F.size(parts) >= len(columns))
    names = F.array(*[F.lit(c) for c in columns])
    return df.withColumns(
        {
            "data": F.when(enough, F.map_from_arrays(names, F.slice(parts, 1, len(columns)))),
            "error": F.when(~F.coalesce(enough, F.lit(False)), "Invalid format. Use: " + ", ".join(columns)),
        }
    )
