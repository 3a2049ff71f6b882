"""Positions and running totals over a whole table without a single-task window.

A unique numeric key is cut into ordered buckets of bounded size. The totals of
the buckets are small enough to broadcast, so each row needs only the sum before
its bucket plus a window inside the bucket.
"""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegralType, NumericType

from flowsift.functions.text import bind
from flowsift.session import written

MAX_BUCKETS = 16_384
MAX_LEVELS = 8
BUCKET_ROWS = 250_000


class KeyRange(NamedTuple):
    low: float | int | None
    high: float | int | None
    rows: int


def key_range(df: DataFrame, key: Column) -> KeyRange:
    """Smallest and largest key and the number of rows. A null key has no position: it is an error."""
    row = df.agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"), F.count_if(key.isNull()).alias("empty")
    ).first()
    if row["empty"]:
        raise ValueError(f"{row['empty']} rows have no key to be ordered by")
    return KeyRange(row["low"], row["high"], row["n"])


def bucket_of(
    df: DataFrame, key: Column, span: KeyRange, bucket_rows: int = BUCKET_ROWS
) -> Column | None:
    """Bucket number that never decreases with the key, or None if one bucket is enough.

    A bucket with too many rows is cut again between its own smallest and largest key,
    so neither clusters nor outliers put most rows into one task. The driver sees one
    (rows, smallest, largest) triple per bucket.
    """
    bucket_rows = max(bucket_rows, math.ceil(span.rows / MAX_BUCKETS))
    if span.rows <= bucket_rows or span.low == span.high:
        return None
    x = key.cast("double")
    bucket = F.lit(0)
    parts = [(span.rows, float(span.low), float(span.high))]
    for _ in range(MAX_LEVELS):
        if not any(n > bucket_rows and low < high for n, low, high in parts):
            break
        cuts = [
            math.ceil(2 * n / bucket_rows) if n > bucket_rows and low < high else 1 for n, low, high in parts
        ]
        bucket = _cut(bucket, x, parts, cuts)
        found = df.groupBy(bucket.alias("b")).agg(
            F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")
        )
        seen = {r["b"]: (r["n"], r["low"], r["high"]) for r in found.collect()}
        parts = [seen.get(b, (0, 0.0, 0.0)) for b in range(sum(cuts))]
    return bucket


def _cut(bucket: Column, x: Column, parts: list[tuple], cuts: list[int]) -> Column:
    bases = _array([0, *itertools.accumulate(cuts)][:-1], "int")
    lows = _array([low for _, low, _ in parts], "double")
    widths = _array([(high / c - low / c) or 1.0 for (_, low, high), c in zip(parts, cuts)], "double")
    tops = _array([c - 1 for c in cuts], "int")

    def inside(b: Column) -> Column:
        step = F.floor((x - F.element_at(lows, b + 1)) / F.element_at(widths, b + 1))
        step = F.greatest(F.lit(0), F.least(step, F.element_at(tops, b + 1)))
        return (F.element_at(bases, b + 1) + step).cast("int")

    return inside(bucket) if len(parts) == 1 else bind(bucket, inside)


def bucket_totals(df: DataFrame, bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Per bucket the sums of all earlier buckets. One row per bucket, a small multiple of MAX_BUCKETS at most."""
    sums = df.groupBy(bucket.alias("_bucket")).agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "_bucket", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values]
    )


def prefix_sums(
    df: DataFrame,
    key: Column,
    values: dict[str, Column],
    span: KeyRange | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add, per row, the sums of `values` over all rows with a smaller key (unique, numeric)."""
    span = span or key_range(df, key)
    bucket = bucket_of(df, key, span, bucket_rows)
    keyed = df.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    earlier = (
        Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = {n: F.coalesce(F.sum(v).over(earlier), F.lit(0)) for n, v in values.items()}
    if bucket is None:
        return keyed.withColumns(inside).drop("_bucket")
    totals = bucket_totals(df, bucket, values)
    summed = keyed.join(F.broadcast(totals), "_bucket").withColumns(
        {n: F.col(f"_before_{n}") + inside[n] for n in values}
    )
    return summed.drop("_bucket", *[f"_before_{n}" for n in values])


def _is_contiguous(df: DataFrame, order_col: str, span: KeyRange) -> bool:
    whole = isinstance(df.schema[order_col].dataType, IntegralType)
    return whole and span.rows > 0 and span.high - span.low + 1 == span.rows


def dense_position(
    df: DataFrame,
    order_col: str,
    start: int = 1,
    name: str = "position",
    span: KeyRange | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Consecutive position by a unique numeric column; by any other kind of column see `ordered_position`.

    Ids without gaps, the normal state of the log, need arithmetic only.
    """
    if not isinstance(df.schema[order_col].dataType, NumericType):
        return ordered_position(df, [order_col], start, name)
    key = F.col(order_col)
    span = span or key_range(df, key)
    if _is_contiguous(df, order_col, span):
        return df.withColumn(name, (key - F.lit(span.low) + F.lit(start)).cast("long"))
    counted = prefix_sums(df, key, {name: F.lit(1)}, span, bucket_rows)
    return counted.withColumn(name, (F.col(name) + F.lit(start)).cast("long"))


def number_rows(df: DataFrame, start: int = 1, name: str = "position") -> DataFrame:
    """Consecutive position in the frame's present physical order, for frames without a key.

    The order is written down first, so a lost executor cannot renumber rows.
    The broadcast side has one row per partition.
    """
    fixed = written(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_row", 33)
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + inside + F.lit(start)).cast("long"))
        .drop("_row", "_part", "_before")
    )


def ordered_position(df: DataFrame, keys: list[str], start: int = 1, name: str = "position") -> DataFrame:
    """Consecutive position by columns of any orderable kind; the last ones break ties.

    Sampled splitters range-partition the rows, each range is sorted by itself, and the ranges'
    row counts (one per range) give every range its first position. Rows with equal values in
    all of `keys` are numbered in some order; a key with many rows is spread over ranges by
    the columns behind it. A null in the first column is an error.
    """
    if not df.where(F.col(keys[0]).isNull()).isEmpty():
        raise ValueError("rows have no key to be ordered by")
    return number_rows(df.repartitionByRange(*keys).sortWithinPartitions(*keys), start, name)


def rows_at(
    df: DataFrame,
    order_col: str,
    ranges: list[tuple[int, int]],
    span: KeyRange | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rows at the positions [offset, offset + length) of every range, with `block` and `position`.

    A row in two ranges comes out twice. Only buckets that touch a range are sorted;
    with gap-free ids the ranges become id predicates on the scan.
    """
    key = F.col(order_col)
    span = span or key_range(df, key)
    if _is_contiguous(df, order_col, span):
        first = [(span.low + o, span.low + o + length) for o, length in ranges]
        near = " OR ".join(f"(`{order_col}` >= {a} AND `{order_col}` < {b})" for a, b in first)
        placed = df.where(near).withColumn("position", (key - F.lit(span.low)).cast("long"))
    else:
        placed = _placed_near(df, key, ranges, span, bucket_rows)
    blocks = F.sequence(F.lit(0), F.lit(len(ranges) - 1))
    offsets = _array([o for o, _ in ranges], "bigint")
    ends = _array([o + n for o, n in ranges], "bigint")
    hits = F.filter(
        blocks,
        lambda b: (F.col("position") >= F.element_at(offsets, b + 1))
        & (F.col("position") < F.element_at(ends, b + 1)),
    )
    # The outer form, as the plain one would test every row of the scan against every block.
    found = placed.select(*placed.columns, F.explode_outer(hits).alias("block"))
    return found.where(F.col("block").isNotNull())


def _placed_near(df, key, ranges, span, bucket_rows) -> DataFrame:
    bucket = bucket_of(df, key, span, bucket_rows)
    if bucket is None:
        return prefix_sums(df, key, {"position": F.lit(1)}, span, bucket_rows)
    totals = bucket_totals(df, bucket, {"n": F.lit(1)}).orderBy("_bucket").collect()
    starts = {r["_bucket"]: r["_before_n"] for r in totals}
    ordered = list(starts.items()) + [(None, span.rows)]
    near = {
        b: before
        for (b, before), (_, after) in zip(ordered, ordered[1:])
        if any(before < o + n and after > o for o, n in ranges)
    }
    if not near:
        return df.where(F.lit(False)).withColumn("position", F.lit(0).cast("long"))
    before = F.create_map(*[F.lit(int(v)) for pair in near.items() for v in pair])
    inside = Window.partitionBy("_bucket").orderBy(key)
    return (
        df.withColumn("_bucket", bucket)
        .where(F.col("_bucket").isin(list(near)))
        .withColumn("position", (F.row_number().over(inside) - 1 + before[F.col("_bucket")]).cast("long"))
        .drop("_bucket")
    )


def _array(values: list, kind: str) -> Column:
    """A constant array from one literal; an element-wise one costs a driver call per element."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class Page(NamedTuple):
    rows: DataFrame
    info: DataFrame


def page(
    df: DataFrame,
    limit: int,
    offset: int,
    default: int = 1000,
    cap: int | None = None,
    order_col: str = "id",
    span: KeyRange | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> Page:
    """One page by id, and (total_rows, returned_rows, limit, offset, has_more).

    A client that walks pages can pass the table's key range, which saves counting it each time.
    """
    limit, offset = page_bounds(limit, offset, default, cap)
    span = span or key_range(df, F.col(order_col))
    rows = rows_at(df, order_col, [(offset, limit)], span, bucket_rows)
    return Page(rows.drop("position", "block").orderBy(order_col), page_info(df.sparkSession, span.rows, limit, offset))


def page_bounds(limit: int, offset: int, default: int = 1000, cap: int | None = None) -> tuple[int, int]:
    """The limit and offset that count: a limit below 1 is the default, an offset below 0 is 0."""
    limit = default if limit < 1 else limit
    return min(limit, cap) if cap else limit, max(offset, 0)


def page_info(spark: SparkSession, total: int, limit: int, offset: int) -> DataFrame:
    returned = max(0, min(limit, total - offset))
    return spark.createDataFrame(
        [(total, returned, limit, offset, offset + returned < total)],
        "total_rows long, returned_rows long, limit long, offset long, has_more boolean",
    )
