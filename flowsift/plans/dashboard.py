"""What the dashboard loads: KPIs, type statistics, a diverse sample of rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from flowsift.operators.sample import block_sample, offset_sample, type_sample
from flowsift.operators.stats import distinct_types, record_kpis, type_stats
from flowsift.sources.decode import decode_records


class Dashboard(NamedTuple):
    kpis: DataFrame
    types: DataFrame
    records: DataFrame
    types_in_view: DataFrame


def dashboard(rec: DataFrame, k: int = 15, limit: int = 100, seed: int = 42) -> Dashboard:
    shown = type_sample(decode_records(offset_sample(rec)), k, limit, seed)
    return Dashboard(record_kpis(rec), type_stats(rec), shown, distinct_types(shown))


def sampled_type_stats(
    rec: DataFrame, threshold: int = 10_000, block: int = 1_000, max_blocks: int = 50
) -> DataFrame:
    """Type statistics from evenly spread blocks; total_rows is the log's, `sampled` says if it is larger than read."""
    rows = rec.count()
    stats = type_stats(block_sample(rec, threshold, block, max_blocks))
    return stats.withColumn("total_rows", F.lit(rows)).withColumn("sampled", F.lit(rows > threshold))
