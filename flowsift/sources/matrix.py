"""Feature matrix and metadata sinks."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.operators.flows import meta


def write_matrix(
    df: DataFrame, path: str, features: str = "features", label: str = "label", keep: tuple[str, ...] = ()
) -> None:
    """float32 features and int32 labels, one partition per split; `keep` columns stay beside them."""
    out = df.select(
        *keep,
        vector_to_array(features, "float32").alias("features"),
        F.col(label).cast("int").alias("label"),
        (F.col("split") if "split" in df.columns else F.lit("all")).alias("split"),
    )
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def read_matrix(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    matrix = spark.read.parquet(path)
    return matrix if split is None else matrix.where(F.col("split") == split)


def write_meta(flows: DataFrame, path: str) -> None:
    meta(flows).write.mode("overwrite").csv(path, header=True)
