import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from flowsift import functions as fn
from flowsift.fixtures import FX_FLOW_RECORDS, table, view
from flowsift.operators import flows, forest, metrics
from flowsift.plans.dashboard import dashboard, sampled_type_stats
from flowsift.plans.offline import run_offline
from flowsift.plans.record_model import test_from_log as evaluate_log
from flowsift.plans.record_model import train_from_log
from flowsift.sources import models, records
from flowsift.sources.decode import decode_records
from flowsift.streaming import predict_stream


def scored(spark, rows):
    return spark.createDataFrame(rows, "event_id long, y int, score double")


def test_published_confusion_matrix(spark):
    cm = spark.createDataFrame([(25330, 650, 1015, 30638)], "tn long, fp long, fn long, tp long")
    got = metrics.metrics_of(cm).first()
    assert got["accuracy"] == pytest.approx(0.9711103013898288, abs=1e-15)
    assert got["precision"] == pytest.approx(0.9792252620813091, abs=1e-15)
    assert got["recall"] == pytest.approx(0.9679335292073421, abs=1e-15)
    assert got["f1_score"] == pytest.approx(0.9735466548037051, abs=1e-15)


def test_published_flags(spark):
    scores = [0.99965, 0.95099, 0.03120, 0.03415, 1.0, 0.30974, 1.0, 0.0, 1.0, 0.27289]
    df = scored(spark, [(i, 0, s) for i, s in enumerate(scores)])
    flags = [r[0] for r in df.orderBy("event_id").select(fn.flag("score", 0.55)).collect()]
    assert flags == [1, 1, 0, 0, 1, 0, 1, 0, 1, 0]
    assert tuple(metrics.anomaly_rate(df.select(fn.flag("score", 0.55).alias("flag"))).first()) == (5, 0.5)


def test_thresholds():
    ts = metrics.thresholds()
    assert len(ts) == 17 and ts[0] == 0.1 and ts[1] == 0.15000000000000002 and ts[10] == 0.6000000000000002


def brute(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(p >= t for p in pos)
        recall, precision = tp / len(pos), tp / (tp + sum(q >= t for q in neg))
        ap, last = ap + (recall - last) * precision, recall
    return auc, ap


@pytest.mark.parametrize("levels, bucket_rows", [(5, 10**6), (400, 20)])
def test_ranking_metrics_against_brute_force(spark, levels, bucket_rows):
    rng = random.Random(levels)
    rows = [(int(rng.random() < 0.4), rng.randrange(levels) / levels) for _ in range(500)]
    df = scored(spark, [(i, y, s) for i, (y, s) in enumerate(rows)]).repartition(4)
    got = metrics.ranking_metrics(df, bucket_rows=bucket_rows).first()
    auc, ap = brute(rows)
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)
    stretched = df.withColumn("score", F.exp(F.col("score") * 3))
    assert metrics.ranking_metrics(stretched).first()["roc_auc"] == pytest.approx(auc)


def test_one_class_only(spark):
    df = scored(spark, [(1, 1, 0.2), (2, 1, 0.9)]).withColumn("pred", fn.flag("score"))
    assert tuple(metrics.ranking_metrics(df).first()) == (0.0, 0.0)
    assert tuple(metrics.confusion_matrix(df).first()) == (0, 0, 1, 1)
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["Safe"]["f1"] == 0.0 and report["Safe"]["support"] == 0
    assert report["weighted avg"]["recall"] == 0.5
    empty = metrics.classification_metrics(df.limit(0)).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    got = {r["label"]: r["weight"] for r in forest.class_weights(df).collect()}
    assert got == {0: 8 / 12, 1: 2.0}


def test_runs_keep_null_metrics_until_tested(spark, tmp_path):
    path = str(tmp_path / "runs")
    models.log_run(path, forest.run_row(spark, "rf", ["a", "b"], {"max_depth": None}, None))
    first = models.latest_run(spark, path, "rf").first()
    assert first["metrics"] is None and first["n_features"] == 2
    assert first["label_mapping"] == {"0": "safe", "1": "unsafe"}
    assert models.load_model(str(tmp_path / "none")) is None


@pytest.fixture(scope="module")
def log(spark, sf):
    return view(spark, sf, "fx_flow_records")


@pytest.fixture(scope="module")
def trained(spark, log, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("records"))
    return out, train_from_log(log, out, trees=15, depth=6)


def test_record_model_round_trip(spark, log, trained):
    out, model = trained
    run = evaluate_log(spark, log, out).first()
    assert run["metrics"]["roc_auc"] > 0.9
    latest = models.latest_run(spark, os.path.join(out, "runs"), "random-forest").first()
    assert latest["metrics"]["accuracy"] == run["metrics"]["accuracy"]
    assert set(latest["feature_names"]) >= {"dur", "proto", "sbytes", "rate"}
    m = decode_records(records.split_scan(log, "testing"))
    loaded = models.load_model(os.path.join(out, "model"))
    a = {r["id"]: r["score"] for r in forest.score(model, m).collect()}
    assert a == {r["id"]: r["score"] for r in forest.score(loaded, m).collect()}


def test_predictions_of_partial_records(spark, trained):
    m = spark.createDataFrame([({"rate": "99", "new": "1"},), ({},), ({"proto": "sctp"},)], "data map<string,string>")
    rows = forest.predict(trained[1], m).collect()
    assert len(rows) == 3
    for r in rows:
        assert r["label"] == {0: "safe", 1: "unsafe"}[r["prediction"]]
        assert math.isclose(r["probability_safe"] + r["probability_unsafe"], 1)
        assert r["confidence"] == max(r["probability_safe"], r["probability_unsafe"])
    assert rows[0]["label"] == "unsafe"


def test_zero_mode_ignores_text_features(spark, log):
    m = decode_records(records.split_scan(log, "training"))
    model = forest.train_record_forest(m, 5, 4, "zero")
    top = forest.importance_topk(model, forest.vector_names(model.transform(m)), None)
    got = {r["feature"]: r["importance"] for r in top.collect()}
    assert got["proto"] == 0.0 and got["rate"] > 0.0


def test_stream_scores_like_batch(spark, sf, trained, tmp_path):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(sf, pathGlobFilter="events.parquet")
    arriving = decode_records(spark.sql(FX_FLOW_RECORDS, events=stream))
    sink, offsets = str(tmp_path / "sink"), str(tmp_path / "offsets")
    for _ in range(2):
        predict_stream(trained[1], arriving, sink, offsets, ("id",)).awaitTermination()
    batch = forest.predict(trained[1], decode_records(view(spark, sf, "fx_flow_records")), ("id",))
    assert sorted(spark.read.parquet(sink).collect()) == sorted(batch.collect())


def test_offline_run(spark, sf, tmp_path):
    raw = flows.rename_headers(view(spark, sf, "fx_raw_flows"))
    out = str(tmp_path / "run")
    run = run_offline(spark, raw, out, trees=10, depth=6).first()
    assert run["metrics"]["roc_auc"] > 0.95 and len(run["metrics"]["feature_importance"]) == 10
    sizes = {r["split"]: r["count"] for r in spark.read.parquet(out + "/matrix").groupBy("split").count().collect()}
    assert sizes == {"train": 800, "test": 200}
    document = json.loads(spark.read.text(out + "/sample_output").first()[0])
    assert len(document["results"]) == 10 and document["threshold"] == 0.5
    assert spark.read.parquet(out + "/sweep").count() == 17


def test_dashboard(spark, sf):
    got = dashboard(view(spark, sf, "fx_records"))
    assert got.kpis.first()["total_records"] == 1000
    assert got.types.count() == 5 and 0 < got.records.count() <= 100
    whole = {r["type"]: r["n"] for r in got.types.collect()}
    assert {r["type"]: r["n"] for r in sampled_type_stats(view(spark, sf, "fx_records")).collect()} == whole
