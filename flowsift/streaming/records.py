"""Continuous ingestion into the record log."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowsift.functions.text import strip
from flowsift.session import written
from flowsift.sources.decode import parse_document
from flowsift.sources.records import dataset_name, to_row_data, write_batch


def ingest_stream(
    spark: SparkSession,
    src_dir: str,
    table: str,
    checkpoint: str,
    dataset: str | None = None,
    fmt: str = "csv",
    schema: StructType | str | None = None,
    max_files: int = 1_000,
    order_col: str | None = None,
) -> StreamingQuery:
    """Append files as they arrive: CSV rows as texts, JSON lines as they are.

    A micro-batch owns one partition of the log, named after the query's checkpoint
    and its batch id. A batch repeated after a failure replaces that partition, so
    every row is stored once. JSON lines that are no object or an empty one are kept as rejects,
    in the same commit (`read_rejects`); the query's progress counts lines as `arrived`
    (lines, stored, rejected). Blank lines are no input.
    """
    name = dataset_name(spark, dataset)
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV stream needs its schema")
        arrived = reader.schema(schema).options(header=True, escape='"').csv(src_dir)
        cells = [F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in arrived.dtypes]
        arrived = arrived.select(*cells)
        order = [] if order_col is None else [F.col(order_col).cast("long").alias("_order")]
        rows = arrived.select(*order, to_row_data(arrived).alias("row_data"))
    elif fmt == "json":
        lines = reader.text(src_dir).where(strip("value") != "").select(F.col("value").alias("row_data"))
        size = F.size(parse_document("row_data"))
        reason = F.when(size == 0, "empty object").when(F.coalesce(size, F.lit(-1)) < 0, "no JSON object")
        rows = lines.withColumn("reason", reason)
        order = []
    else:
        raise ValueError("fmt must be 'csv' or 'json'")
    refused = F.col("reason").isNotNull() if fmt == "json" else F.lit(False)
    rows = rows.observe(
        "arrived", F.count("*").alias("lines"), F.count_if(~refused).alias("stored"), F.count_if(refused).alias("rejected")
    )
    source = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def store(batch: DataFrame, batch_id: int) -> None:
        lines = written(batch, "arrived")  # the batch runs once: later steps and its counts agree
        if lines.isEmpty():
            return
        now, key = dt.datetime.now(dt.timezone.utc), f"{source}-{batch_id}"
        if fmt == "csv":
            write_batch(lines, table, name, key, now, "_order" if order else None)
        else:
            good, bad = lines.where("reason IS NULL").select("row_data"), lines.where("reason IS NOT NULL")
            write_batch(good, table, name, key, now, rejects=bad)

    return (
        rows.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
