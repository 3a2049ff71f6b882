"""Headline timings: one JSON line, seconds per query (warm, median of three).

Jobs of more than two seconds and trainings are timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from flowsift.fixtures import view
from flowsift.operators import flows, forest, prep
from flowsift.plans.offline import prepare_matrix
from flowsift.queries import QUERIES
from flowsift.session import build_session, spread, written
from flowsift.sources.decode import decode_records

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "flowsift-bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def once(name: str, job):
        start = time.perf_counter()
        out = job()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    def warm(name: str, job, repeats: int = 3) -> None:
        start = time.perf_counter()
        job()
        taken: list[float] = []
        for _ in range(repeats if time.perf_counter() - start < 2 else 1):
            start = time.perf_counter()
            job()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(name, seconds[name], file=sys.stderr)

    rec = view(spark, SF_DIR, "fx_records")
    sc = view(spark, SF_DIR, "fx_scored")
    for name in (
        "type_distribution", "type_by_split", "type_stats", "record_kpis", "record_decode",
        "type_extract_display", "record_flatten", "any_column_search", "records_to_features",
        "threshold_sweep", "roc_auc", "classification_report", "random_split_exact",
        "stratified_split", "type_sample", "block_sample", "page", "dense_position",
        "drop_remainder", "median_impute", "standard_scale", "one_hot", "flow_csv_scan",
        "record_ingest", "record_ingest_stream", "record_ingest_csv",
    ):
        warm(name, lambda: run(QUERIES[name](spark, SF_DIR)))

    # The published set-up: 200 trees, depth 20, balanced weights, about 66,000 training rows.
    raw = flows.rename_headers(view(spark, SF_DIR, "fx_raw_flows"))
    prepared = once("prepare_matrix", lambda: prepare_matrix(raw))
    train, test = (prepared.matrix.where(F.col("split") == part) for part in ("train", "test"))
    model = once("rf_train_weighted_200x20", lambda: forest.train_forest(train))
    warm("rf_score", lambda: run(model.transform(test).select("probability")))
    warm("evaluate_model", lambda: run(forest.evaluate(model, test, names=prepared.names)))

    small = written(spread(flows.prepare_flows(view(spark, SF_DIR, "fx_flows"))), "bench")
    fitted = once("preprocess_fit_lineitem", lambda: prep.fit_preprocess(small, flows.numeric_features(small)))
    vectors = fitted.transform(small).withColumn("label", F.col("Label"))
    warm("preprocess_transform_lineitem", lambda: run(vectors.select("features")))
    once("rf_train_lineitem_20x8", lambda: forest.train_forest(vectors, 20, 8))

    m = decode_records(spread(view(spark, SF_DIR, "fx_flow_records")))
    records_model = once("rf_train_records_100x30", lambda: forest.train_record_forest(m, depth=30))
    warm("predict_records", lambda: run(forest.predict(records_model, m)))
    pure_model = once("rf_train_records_100_pure", lambda: forest.train_record_forest(m))
    warm("predict_records_pure", lambda: run(forest.predict(pure_model, m)))
    rows = {"records": rec.count(), "scored": sc.count(), "train": train.count(), "lineitem": small.count()}

    print(
        json.dumps(
            {
                "metric": "flow_analytics_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
