"""Flow CSV -> matrix -> weighted forest -> evaluation -> artifacts."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.operators.flows import numeric_features, prepare_flows
from flowsift.operators.forest import evaluate, train_forest, vector_names
from flowsift.operators.metrics import threshold_sweep
from flowsift.operators.prep import fit_preprocess
from flowsift.operators.split import stratified_split
from flowsift.session import dealt, small_methods, written
from flowsift.sources.matrix import write_matrix, write_meta
from flowsift.sources.models import log_run, save_model
from flowsift.sources.requests import score_document


class Prepared(NamedTuple):
    model: PipelineModel
    matrix: DataFrame
    names: list[str]


def prepare_matrix(
    flows: DataFrame,
    test_size: float = 0.2,
    seed: int = 42,
    fit_on: str = "all",
    id_col: str = "id",
) -> Prepared:
    """Cleaned flows -> (fitted preprocessing, id/features/label/split, feature names)."""
    ready = stratified_split(prepare_flows(flows), "Label", test_size, seed, id_col)
    # Statistics and forest read the cleaned rows many times; one written copy serves them all.
    with small_methods(flows.sparkSession):
        ready = written(dealt(ready, flows), "flows")
    model = fit_preprocess(ready, numeric_features(ready), fit_on=fit_on)
    out = model.transform(ready)
    matrix = out.select(id_col, "features", F.col("Label").alias("label"), "split")
    return Prepared(model, matrix, vector_names(matrix))


def run_offline(
    spark: SparkSession,
    flows: DataFrame,
    out_dir: str,
    trees: int = 200,
    depth: int = 20,
    threshold: float = 0.5,
    seed: int = 42,
    fit_on: str = "all",
    request_id: str = "rf-test-001",
    version: str = "random-forest-v1.0",
) -> DataFrame:
    """Train and evaluate, writing every artifact below out_dir; returns the run row."""
    prepared = prepare_matrix(flows, seed=seed, fit_on=fit_on)
    matrix_path = os.path.join(out_dir, "matrix")
    write_meta(flows, os.path.join(out_dir, "meta"))
    save_model(prepared.model, os.path.join(out_dir, "preprocess"))
    write_matrix(prepared.matrix, matrix_path, keep=("id",))
    train = prepared.matrix.where(F.col("split") == "train")
    test = prepared.matrix.where(F.col("split") == "test")
    forest = train_forest(train, trees, depth, seed=seed)
    save_model(PipelineModel([forest]), os.path.join(out_dir, "forest"))
    params = {"n_estimators": trees, "max_depth": depth, "class_weight": "balanced", "random_state": seed}
    run = evaluate(forest, test, names=prepared.names, params=params, threshold=threshold, topk=10)
    log_run(os.path.join(out_dir, "runs"), run)
    p = vector_to_array("probability")[1]
    scored = forest.transform(test).select("id", F.col("label").alias("y"), p.alias("score"))
    sc = written(scored, "scored")
    threshold_sweep(sc).write.mode("overwrite").parquet(os.path.join(out_dir, "sweep"))
    score_document(sc, request_id, version, threshold, id_col="id").write.mode(
        "overwrite"
    ).text(os.path.join(out_dir, "sample_output"))
    return run
