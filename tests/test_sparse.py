"""Features without a column per key: the same values as the wide form, and many keys."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowsift.fixtures import view
from flowsift.operators import features, forest, position, prep, sparse
from flowsift.sources.decode import decode_records


def test_same_values_as_the_wide_form(spark, sf):
    m = decode_records(view(spark, sf, "fx_flow_records"))
    keys = sparse.record_dictionary(m)
    names = [r.key for r in keys.orderBy("slot").collect()]
    assert names == features.record_feature_keys(m)
    wide = features.records_to_features(m)
    columns = wide.columns[2:]
    wide = features.zero_fill(features.coerce_numeric(wide, columns), columns)
    want = {r["id"]: [r[c] for c in columns] for r in wide.collect()}
    for limit in (None, 0):  # broadcast, and joined by key
        form = sparse.as_vectors(sparse.record_slots(m, keys, broadcast_bytes=limit))
        assert {r.id: r.x for r in form.select("id", vector_to_array("features").alias("x")).collect()} == want
    labels = {r.id: r.label for r in sparse.record_vectors(m, keys).collect()}
    assert labels == {r.id: r.label for r in features.valid_labels(features.records_to_features(m, [])).collect()} | {
        i: None for i, v in labels.items() if v is None
    }


def test_records_without_known_keys(spark):
    rows = [(1, {"label": "1", "a": "x"}), (2, {}), (3, None), (4, {"label": "0", "a": "2", "b": " 3 ", "id": "9"}), (5, {"c": "1"})]
    m = spark.createDataFrame(rows, "id long, data map<string,string>")
    keys = sparse.record_dictionary(m.where("id < 5"))
    assert {r.key: r.n for r in keys.collect()} == {"a": 2, "b": 1}
    got = {r.id: (r.label, r.features.size, r.features.toArray().tolist()) for r in sparse.record_vectors(m, keys).collect()}
    assert got == {1: (1, 2, [0, 0]), 2: (None, 2, [0, 0]), 3: (None, 2, [0, 0]), 4: (0, 2, [2, 3]), 5: (None, 2, [0, 0])}
    with pytest.raises(ValueError, match="label"):
        sparse.record_dictionary(m.where("id = 5"))


def test_two_hundred_thousand_keys(spark):
    own = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.concat(F.lit("k"), (F.col("id") * 500 + i).cast("string")))
    names = F.concat(F.array(F.lit("label"), F.lit("rate")), own)
    texts = F.concat(
        F.array((F.col("id") % 2).cast("string"), F.when(F.col("id") % 2 == 1, "7.5").otherwise("1")), F.array_repeat(F.lit("1"), 500)
    )
    m = spark.range(400).select("id", F.map_from_arrays(names, texts).alias("data"))
    model = forest.train_sparse_forest(m, trees=30, depth=4)
    assert model.keys.count() == 200_001
    assert model.keys.agg(F.countDistinct("slot"), F.min("slot"), F.max("slot")).first() == (200_001, 0, 200_000)
    scored = forest.predict(model, m.where("id < 40"), ("id",))
    assert scored.count() == 40 and scored.columns[-1] == "confidence"
    assert forest.forest_of(model).numFeatures == 200_001


def test_categories_equal_the_columns(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["tcp", "udp", None, "arp"]), rng.choice(["", "x", "y z"]), rng.choice([0.0, 2.5, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, proto string, state string, v double")
    fit = df.where("id < 150")
    cats = sparse.category_dictionary(fit, ["proto", "state"])
    more = df.unionByName(spark.createDataFrame([(999, "sctp", None, 1.0)], df.schema))
    hot = prep.one_hot(more, prep.fit_categories(fit, ["proto", "state"]), ["proto", "state"])
    names = [f"{c}_{r['value']}" for c in ("proto", "state") for r in prep.fit_categories(fit, ["proto", "state"]).orderBy("pos").collect() if r["col"] == c]
    want = {r["id"]: [r["v"] or 0.0, *[r[n] for n in names]] for r in hot.collect()}
    for limit in (None, 0):
        form = sparse.as_vectors(sparse.one_hot_slots(more, ["v"], cats, broadcast_bytes=limit))
        assert {r["id"]: r["features"].toArray().tolist() for r in form.collect()} == want
    assert sparse.one_hot_vectors(more, ["v"], cats).schema == form.schema


def test_a_million_categories_and_a_hot_one(spark):
    df = spark.range(1_500_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), "id")).alias("proto"))
    cats = sparse.category_dictionary(df, ["proto"])
    assert cats["proto"].count() == 1_000_001
    out = sparse.one_hot_slots(df, [], cats, broadcast_bytes=1000)
    found = out.agg(F.count("*"), F.countDistinct("features.indices"), F.count_if(F.size("features.indices") == 1)).first()
    assert found == (1_500_000, 1_000_001, 1_500_000)


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_by_text_time_and_repeated_keys(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i, rng.choice(["", "a", "b", "é", "zz"]), rng.choice([-1.5, 0.0, 2.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string, v double").repartition(partitions)
    got = {r.id: r.position for r in position.ordered_position(df, ["t", "v", "id"], 0).collect()}
    order = sorted(rows, key=lambda r: (r[1].encode(), r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}
    alone = sorted((r.position, r.t) for r in position.dense_position(df, "t").collect())
    assert [p for p, _ in alone] == list(range(1, 501)) and [t for _, t in alone] == [r[1] for r in order]
    with pytest.raises(ValueError, match="no key"):
        position.ordered_position(df.unionByName(spark.createDataFrame([(1, None, 1.0)], df.schema)), ["t"])
    assert position.ordered_position(df.limit(0), ["t"]).count() == 0


def test_too_many_columns_are_refused(spark, monkeypatch):
    m = spark.createDataFrame([(1, {"label": "1", "a": "1", "b": "2"})], "id long, data map<string,string>")
    monkeypatch.setattr(features, "MAX_KEYS", 2)
    with pytest.raises(ValueError, match="sparse"):
        features.record_keys(m)
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "proto string")
    assert [r.name for r in prep.feature_names(df, ["x"], ["proto"]).orderBy("pos").collect()] == ["x", "proto_a", "proto_b", "proto_c"]
    monkeypatch.setattr(prep, "MAX_CATEGORIES", 2)
    with pytest.raises(ValueError, match="sparse"):
        prep.one_hot(df, prep.fit_categories(df, ["proto"]), ["proto"])
