"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(taken: Iterable[str], base: str) -> str:
    """A column name that no column in `taken` has, whatever its case."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base += "_"
    return base


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, and its path.

    Every table cuts the lineage: a lost executor costs the tasks since the last one.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def with_salt(df: DataFrame, salts: int, name: str) -> DataFrame:
    """Deal the rows of a stored frame evenly to `salts` numbers, repeated rows too."""
    return df.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as a long; a null text has no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
