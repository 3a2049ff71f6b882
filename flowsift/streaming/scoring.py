"""Continuous scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from flowsift.operators.forest import predict
from flowsift.operators.nodes import NodeForest


def predict_stream(
    model: PipelineModel | NodeForest, stream: DataFrame, sink: str, checkpoint: str, keep: tuple[str, ...] = ()
) -> StreamingQuery:
    """Score arriving records (map column `data`) into a Parquet sink; stateless."""
    return (
        predict(model, stream, keep)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
