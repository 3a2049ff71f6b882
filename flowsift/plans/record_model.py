"""Record log -> train on its training rows -> test on its testing rows."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.functions import parse_number
from flowsift.operators.features import record_feature_keys
from flowsift.operators.forest import evaluate, run_row, train_record_forest
from flowsift.operators.nodes import NodeForest
from flowsift.schema import TESTING, TRAINING
from flowsift.session import dealt
from flowsift.sources.decode import decode_records
from flowsift.sources.models import load_model, log_run, save_model
from flowsift.sources.records import require_split, split_scan


def train_from_log(
    rec: DataFrame,
    out_dir: str,
    trees: int = 100,
    depth: int | None = None,
    seed: int = 42,
    categorical: str = "index",
    name: str = "random-forest",
) -> PipelineModel | NodeForest:
    """Train on the rows labelled 'training'; the run is logged with metrics still null."""
    m = decode_records(dealt(split_scan(require_split(rec), TRAINING)))
    features = record_feature_keys(m)
    model = train_record_forest(m, trees, depth, categorical, seed, features)
    save_model(model, os.path.join(out_dir, "model"))
    params = {"n_estimators": trees, "max_depth": depth, "random_state": seed}
    log_run(os.path.join(out_dir, "runs"), run_row(rec.sparkSession, name, features, params, None))
    return model


def test_from_log(
    spark: SparkSession, rec: DataFrame, out_dir: str, name: str = "random-forest"
) -> DataFrame:
    """Evaluate the saved model on the rows labelled 'testing' and log the run."""
    model = load_model(os.path.join(out_dir, "model"))
    if model is None:
        raise LookupError("no trained model: train first")
    m = decode_records(dealt(split_scan(require_split(rec), TESTING)))
    label = parse_number(F.try_element_at(F.col("data"), F.lit("label")))
    run = evaluate(model, m, label, name)
    log_run(os.path.join(out_dir, "runs"), run)
    return run


test_from_log.__test__ = False  # not a pytest case
