"""Large inputs in few pieces: rows are dealt to all cores, documents parsed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift import session
from flowsift.fixtures import view
from flowsift.operators import forest, nodes
from flowsift.sources.decode import decode_records


def test_pieces_follow_the_bytes(spark, monkeypatch):
    one = spark.range(1000, numPartitions=1)
    assert session.dealt(one).rdd.getNumPartitions() == 8
    monkeypatch.setattr(session, "SMALL_BYTES", 400)  # 8 bytes a row
    assert session.dealt(one).rdd.getNumPartitions() == 20
    product = one.crossJoin(one.withColumnRenamed("id", "other"))
    assert session.dealt(product, one).rdd.getNumPartitions() == 20
    assert sorted(r.id for r in session.dealt(one).collect()) == list(range(1000))


def test_documents_are_parsed_once_in_training(spark):
    made = [(i, {"rate": str(i), "sbytes": str(i % 7), "label": str(i % 2)}) for i in range(60)]
    m, seen = spark.createDataFrame(made, "id long, data map<string,string>"), spark.sparkContext.accumulator(0)

    @F.udf("map<string,string>")
    def counted(data):
        seen.add(1)
        return data

    model = forest.train_record_forest(m.withColumn("data", counted("data")), trees=2, depth=3)
    assert forest.forest_of(model).getNumTrees == 2
    assert seen.value == 60


def test_evaluation_leaves_out_records_without_a_label(spark, sf):
    m = decode_records(view(spark, sf, "fx_flow_records"))
    label = F.try_element_at(F.col("data"), F.lit("label"))
    known = F.when(label.isin("0", "1"), label)
    model = forest.train_record_forest(m, trees=3, depth=4)
    with_some = forest.evaluate(model, m, known).first()["metrics"]
    only_known = forest.evaluate(model, m.where(known.isNotNull()), known).first()["metrics"]
    assert with_some["confusion_matrix"] == only_known["confusion_matrix"]
    assert with_some["roc_auc"] == pytest.approx(only_known["roc_auc"])


def test_categories_of_many_places_are_looked_up_together():
    rng = np.random.default_rng(1)
    categories = {p: rng.choice(9, rng.integers(0, 6), replace=False).astype(float) for p in (0, 3, 7)}
    none = np.zeros(0, np.int64)
    made = nodes.Compiled(none, none, none, none, none.astype(float), none, none, none, categories)
    place = rng.choice([0, 3, 7], 500)
    value = rng.choice([*range(-1, 12), 0.5, np.nan, np.inf, 1e300], 500).astype(float)
    want = [bool(np.isin(v, categories[p])) for p, v in zip(place.tolist(), value)]
    assert made._listed(place, value).tolist() == want
    empty = nodes.Compiled(none, none, none, none, none.astype(float), none, none, none, {0: np.zeros(0)})
    assert empty._listed(np.array([0, 0]), np.array([0.0, 1.0])).tolist() == [False, False]
