"""Cleaning and feature engineering of the flow table; all map-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType

from flowsift.functions import byte_ratio, flow_rate, pkt_rate, pkt_ratio
from flowsift.schema import CATEGORICAL, ENGINEERED, META, NOT_FEATURES, RENAMES, REQUIRED

NUMERIC = (IntegerType, LongType, FloatType, DoubleType)


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip() for c in df.columns])


def rename_headers(df: DataFrame, mapping: dict[str, str] = RENAMES) -> DataFrame:
    return df.toDF(*[mapping.get(c, c) for c in df.columns])


def missing_column_names(df: DataFrame, required: list[str] = REQUIRED) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def missing_columns(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    rows = [(c,) for c in missing_column_names(df, required)]
    return df.sparkSession.createDataFrame(rows, "missing_column string")


def validate(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    missing = missing_column_names(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def cast_label(df: DataFrame, label: str = "Label") -> DataFrame:
    """Label as int; a null label fails the query."""
    value = F.col(label)
    fail = F.raise_error(F.lit(f"{label} is null"))
    return df.withColumn(label, F.when(value.isNull(), fail).otherwise(value.cast("int")))


def inf_to_null(df: DataFrame) -> DataFrame:
    """Infinities and NaN of the floating-point columns become null."""
    cleaned = {
        f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name))
        for f in df.schema
        if isinstance(f.dataType, (FloatType, DoubleType))
    }
    return df.withColumns(cleaned) if cleaned else df


def fill_categoricals(df: DataFrame, value: str = "unknown") -> DataFrame:
    text = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    return df.na.fill(value, subset=text) if text else df


def add_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "byte_ratio": byte_ratio(),
            "pkt_ratio": pkt_ratio(),
            "flow_rate": flow_rate(),
            "pkt_rate": pkt_rate(),
        }
    )


def prepare_flows(df: DataFrame) -> DataFrame:
    """Clean first, then engineer, as the ratios of missing inputs must stay missing."""
    return add_features(fill_categoricals(inf_to_null(df)))


def numeric_features(
    df: DataFrame,
    exclude: list[str] = NOT_FEATURES,
    categorical: list[str] = CATEGORICAL,
    engineered: list[str] = ENGINEERED,
) -> list[str]:
    """Numeric columns in table order; undeclared ones count too."""
    found = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, NUMERIC) and f.name not in exclude and f.name not in categorical
    ]
    return found + [c for c in engineered if c in df.columns and c not in found]


def keep_features(df: DataFrame, numeric: list[str], categorical: list[str] = CATEGORICAL) -> DataFrame:
    return df.select(*numeric, *categorical)


def meta(flows: DataFrame) -> DataFrame:
    return flows.select(*[c for c in META if c in flows.columns])
