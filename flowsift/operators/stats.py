"""Counts for dashboards: KPIs and type statistics, each one aggregation over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.functions import normalise_type, strip, type_of
from flowsift.operators.position import number_rows
from flowsift.schema import TESTING, TRAINING
from flowsift.session import spread, written
from flowsift.sources.decode import parse_document


def _share(n: Column, total: Column, digits: int) -> Column:
    return F.round(F.coalesce(F.try_divide(n, total) * 100, F.lit(0.0)), digits)


def record_kpis(rec: DataFrame) -> DataFrame:
    total = F.count("*")
    training, testing = F.count_if(F.col("T") == TRAINING), F.count_if(F.col("T") == TESTING)
    return rec.agg(
        total.alias("total_records"),
        training.alias("training_records"),
        testing.alias("testing_records"),
        _share(training, total, 1).alias("training_percentage"),
        _share(testing, total, 1).alias("testing_percentage"),
    )


COUNTS = ["n", "n_training", "n_testing", "n_parsed", "n_rows"]


def typed_counts(rec: DataFrame, *by: str) -> DataFrame:
    """(type, n, n_training, n_testing, n_parsed, n_rows), per value of `by`; the null type holds untyped rows.

    Counts of parts of a log add up to those of the whole; a table of such counts is returned as
    it is, so every statistic takes one in place of rows.
    """
    if set(COUNTS) <= set(rec.columns):
        return rec
    # Rows are dropped only after the aggregation: a filter on the type would make
    # the scan parse every document twice.
    split = F.lower("T")
    typed = spread(rec.select(*by, "row_data", "T")).withColumn("data", parse_document("row_data"))
    typed = typed.select(*by, normalise_type(type_of("data")).alias("type"), split.alias("T"), "data")
    return typed.groupBy(*by, "type").agg(
        F.count("type").alias("n"),
        F.count(F.when(F.col("T") == TRAINING, F.col("type"))).alias("n_training"),
        F.count(F.when(F.col("T") == TESTING, F.col("type"))).alias("n_testing"),
        F.count("data").alias("n_parsed"),
        F.count("*").alias("n_rows"),
    )


def add_counts(parts: DataFrame) -> DataFrame:
    """Counts of several parts of a log as those of the whole."""
    return parts.groupBy("type").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _counts_once(rec: DataFrame) -> DataFrame:
    """Typed counts to be read for rows and for totals; the documents are parsed once."""
    return written(typed_counts(rec), "types")


def type_by_split(rec: DataFrame) -> DataFrame:
    return typed_counts(rec).where(F.col("n") > 0).select("type", "n", "n_training", "n_testing")


def type_distribution(rec: DataFrame) -> DataFrame:
    return typed_counts(rec).where(F.col("n") > 0).select("type", "n")


def type_percentages(rec: DataFrame) -> DataFrame:
    counts = _counts_once(rec)
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("n") > 0).select("type", _share(F.col("n"), total, 2).alias("pct"))


def type_stats(rec: DataFrame) -> DataFrame:
    """Everything the type chart needs: counts, shares, rows read and rows in the log."""
    counts = _counts_once(rec)
    return counts.where(F.col("n") > 0).select(
        "type",
        "n",
        "n_training",
        "n_testing",
        _share(F.col("n"), counts.agg(F.sum("n")).scalar(), 2).alias("pct"),
        counts.agg(F.sum("n_parsed")).scalar().alias("sample_size"),
        counts.agg(F.sum("n_rows")).scalar().alias("total_rows"),
    )


def type_ranking(rec: DataFrame) -> DataFrame:
    """Types by falling count, equal counts by name; ranks follow a distributed sort."""
    ordered = type_distribution(rec).orderBy(F.desc("n"), "type")
    return number_rows(ordered, name="rank").select("rank", "type", "n")


def class_balance(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def distinct_types(m: DataFrame, type_col: str = "type") -> DataFrame:
    shown = F.coalesce(F.nullif(strip(F.col(type_col).cast("string")), F.lit("")), F.lit("—"))
    return m.agg(F.count_distinct(shown).alias("n"))
