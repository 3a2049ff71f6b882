"""Decoded records -> numeric feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsift.functions import parse_number
from flowsift.schema import RECORD_NOT_FEATURES


#: Keys that become columns; more are an error, and `operators.sparse` takes any number.
MAX_KEYS = 20_000


def record_keys(m: DataFrame, order_col: str = "id") -> list[str]:
    """Every key of the log, in order of first appearance; more than MAX_KEYS are an error."""
    # The outer form, as the plain one would have every document parsed for an emptiness filter too.
    keys = m.select(order_col, F.posexplode_outer(F.map_keys("data")).alias("pos", "key"))
    first = keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(order_col, "pos")).alias("seen"))
    found = first.orderBy("seen").limit(MAX_KEYS + 1).collect()
    if len(found) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys cannot become columns: use the sparse form")
    return [r["key"] for r in found]


def column_names(keys: list[str]) -> list[str]:
    """Column names for keys; keys equal but for case get a number, as Spark ignores case."""
    seen: dict[str, int] = {}
    out = []
    for key in keys:
        n = seen[key.lower()] = seen.get(key.lower(), 0) + 1
        out.append(key if n == 1 else f"{key}__{n}")
    return out


def record_feature_keys(m: DataFrame, order_col: str = "id") -> list[str]:
    keys = record_keys(m, order_col)
    if "label" not in keys:
        raise ValueError("no record has a 'label' key")
    return [k for k in keys if k not in RECORD_NOT_FEATURES]


def records_to_features(m: DataFrame, features: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """(id, label, f1..fk), all text; a missing key is null. A given list saves the key scan."""
    features = record_feature_keys(m, id_col) if features is None else features
    names = column_names([id_col, "label", *features])[2:]
    value = {k: F.try_element_at(F.col("data"), F.lit(k)) for k in ["label", *features]}
    return m.select(
        id_col, value["label"].alias("label"), *[value[k].alias(n) for k, n in zip(features, names)]
    )


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: parse_number(c) for c in cols})


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.fill(0.0, subset=cols)


def valid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a numeric label, which is cut to int."""
    return df.withColumn(label, parse_number(label).cast("int")).where(F.col(label).isNotNull())


def align_features(df: DataFrame, features: list[str], keep: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """The training features in training order; absent ones are 0, extra ones go."""
    kept = [c for c in keep if c in df.columns]
    return df.select(
        *kept, *[F.col(f"`{c}`") if c in df.columns else F.lit(0.0).alias(c) for c in features]
    )


def common_feature_names(train: DataFrame, test: DataFrame, keep: tuple[str, ...] = ("id", "label")) -> list[str]:
    return [c for c in train.columns if c in test.columns and c not in keep]


def common_features(
    train: DataFrame, test: DataFrame, keep: tuple[str, ...] = ("id", "label")
) -> tuple[DataFrame, DataFrame]:
    names = common_feature_names(train, test, keep)
    return align_features(train, names, keep), align_features(test, names, keep)
