"""Saved models and the table of model runs."""

from __future__ import annotations

import logging
import os

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from py4j.protocol import Py4JJavaError

from flowsift.operators.nodes import NODES, NodeForest, model_nodes
from flowsift.schema import MODEL_RUN

log = logging.getLogger(__name__)
FRONT, NODES_DIR = "front", "nodes"


def save_model(model: PipelineModel | NodeForest, path: str) -> None:
    """Save a fitted pipeline or a node forest; the forest's node table lies beside it in `nodes`.

    What was at the path before goes. A node forest is an empty pipeline with its stages in `front`.
    """
    own = isinstance(model, NodeForest)
    (PipelineModel([]) if own else model).write().overwrite().save(path)
    if own:
        model.front.write().save(os.path.join(path, FRONT))
    forest = model if own else next((s for s in model.stages if isinstance(s, RandomForestClassificationModel)), None)
    if forest is not None:
        (model.nodes if own else model_nodes(forest)).write.parquet(os.path.join(path, NODES_DIR))


def load_model(path: str) -> PipelineModel | NodeForest | None:
    """The saved model, or None when there is none that can be read ("not trained")."""
    try:
        model = PipelineModel.load(path)
        if not model.stages:
            front = PipelineModel.load(os.path.join(path, FRONT))
            return NodeForest(load_nodes(path), front)
        return model
    except (PySparkException, Py4JJavaError) as e:
        log.warning("no model at %s: %s", path, str(e).splitlines()[0])
        return None


def load_nodes(path: str) -> DataFrame:
    """The node table of the forest saved at `path`."""
    return SparkSession.active().read.schema(NODES).parquet(os.path.join(path, NODES_DIR))


def log_run(table: str, run: DataFrame) -> None:
    """Append a run; earlier rows are never rewritten."""
    run.select(*[f.name for f in MODEL_RUN]).write.mode("append").parquet(table)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest row per model, combined on the map side."""
    newest = runs.groupBy("model").agg(F.max_by(F.struct(*runs.columns), "logged_at").alias("r"))
    return newest.select("r.*")


def latest_run(spark: SparkSession, table: str, model: str) -> DataFrame:
    return latest_runs(spark.read.schema(MODEL_RUN).parquet(table).where(F.col("model") == model))
