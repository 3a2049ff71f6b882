"""Positional and per-type samples (their size is the feature)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowsift.functions import display_type_of
from flowsift.operators.position import key_range, rows_at
from flowsift.operators.split import shuffle_key


def block_offsets(n: int, threshold: int, block: int, max_blocks: int) -> list[tuple[int, int]]:
    """(offset, length) of evenly spread blocks, the last at the end; the whole table up to `threshold` rows."""
    if n <= threshold:
        return [(0, n)]
    blocks = max(2, min(max_blocks, n // block))
    return [(min(i * (n // (blocks - 1)), max(0, n - block)), block) for i in range(blocks)]


def block_sample(
    df: DataFrame,
    threshold: int = 10_000,
    block: int = 1_000,
    max_blocks: int = 50,
    order_col: str = "id",
    dedupe: bool = False,
) -> DataFrame:
    """Rows of the blocks, with `block`. Overlapping blocks repeat rows unless `dedupe`."""
    span = key_range(df, F.col(order_col))
    if span.rows <= threshold:
        return df.withColumn("block", F.lit(0))
    ranges = block_offsets(span.rows, threshold, block, max_blocks)
    if dedupe:
        ends = [o for o, _ in ranges[1:]] + [span.rows]
        ranges = [(o, min(n, end - o)) for (o, n), end in zip(ranges, ends)]
    return rows_at(df, order_col, ranges, span).drop("position")


def offset_sample(df: DataFrame, blocks: int = 20, size: int = 50, order_col: str = "id") -> DataFrame:
    """`size` rows from each of `blocks` evenly spread offsets; small tables repeat rows."""
    span = key_range(df, F.col(order_col))
    offsets = sorted({span.rows * i // blocks for i in range(blocks)} if span.rows else set())
    if not offsets:
        return df.withColumn("block", F.lit(0))
    return rows_at(df, order_col, [(o, size) for o in offsets], span).drop("position")


def type_sample(
    m: DataFrame, k: int = 15, limit: int = 100, seed: int = 42, id_col: str = "id"
) -> DataFrame:
    """Up to k random rows per displayed type, by type then id, `limit` rows in all.

    The rank filter keeps k rows per type on the map side, so a hot type is not sorted in one task.
    """
    typed = m.select(
        id_col,
        "upload_timestamp",
        F.coalesce("T", F.lit("-")).alias("t"),
        display_type_of("data").alias("type"),
        shuffle_key(id_col, seed).alias("_h"),
    )
    order = Window.partitionBy("type").orderBy("_h", id_col)
    return (
        typed.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= k)
        .drop("_r", "_h")
        .orderBy("type", id_col)
        .limit(limit)
    )
