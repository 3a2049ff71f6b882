"""Forests as node tables: agreement with MLlib, growth to purity, measured importances."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowsift.fixtures import FOREST, FOREST_FEATURES, forest_nodes, view
from flowsift.operators import forest, nodes
from flowsift.plans.record_model import test_from_log as evaluate_log
from flowsift.plans.record_model import train_from_log
from flowsift.sources import models, records
from flowsift.sources.decode import decode_records


@pytest.fixture(scope="module")
def log(spark, sf):
    return view(spark, sf, "fx_flow_records")


@pytest.fixture(scope="module")
def mllib(log):
    return forest.train_record_forest(decode_records(records.split_scan(log, "training")), 12, 7)


def test_table_agrees_with_mllib(spark, log, mllib, tmp_path):
    models.save_model(mllib, str(tmp_path / "m"))
    table = models.load_nodes(str(tmp_path / "m"))
    assert table.where(F.col("categories").isNotNull()).count() > 0  # proto is split by its values
    fitted = forest.forest_of(mllib)
    assert table.count() == fitted.totalNumNodes
    m = decode_records(records.split_scan(log, "testing"))
    vectors = mllib.transform(m).select("id", "features", "probability", "prediction")
    again = nodes.NodeForest(table).transform(vectors.select("id", "features"))
    p = lambda df: {r.id: (*r.p, r.prediction) for r in df.select("id", vector_to_array("probability").alias("p"), "prediction").collect()}
    want, got = p(vectors), p(again)
    assert want.keys() == got.keys() and len(got) > 500
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-12)
    slots = {r.slot: r.importance for r in nodes.node_importances(table).collect()}
    assert [slots.get(i, 0.0) for i in range(fitted.numFeatures)] == pytest.approx(fitted.featureImportances.toArray().tolist())


def table_of(spark, rows):
    """rows: (features, label); written down with a row number."""
    made = [(i, int(y), 1.0, [float(v) for v in x]) for i, (x, y) in enumerate(rows)]
    return spark.createDataFrame(made, "row long, label int, weight double, x array<double>").repartition(3)


def stump(spark, trees=1):
    leaf = [(t, 0, None, None, None, None, None, [0.5, 0.5], None, 1.0) for t in range(trees)]
    return spark.createDataFrame(leaf, nodes.NODES)


def classes(table, rows):
    scored = nodes.NodeForest(table).transform(rows.select("row", "label", array_to_vector("x").alias("features")))
    return {r.row: (r.label, int(r.prediction)) for r in scored.select("row", "label", "prediction").collect()}


def depth_of(table):
    parent = {}
    for r in table.collect():
        for child in (r.left, r.right):
            if child is not None:
                parent[child] = r.node
    deepest = 0
    for node in parent:
        steps = 0
        while node in parent:
            node, steps = parent[node], steps + 1
        deepest = max(deepest, steps)
    return deepest


def test_chain_of_forty_levels(spark):
    """Labels alternate along one feature that doubles: far more cuts than MLlib's bins part, fitted exactly."""
    records_ = [({"label": str(i % 2), "rate": str(float(2**i))},) for i in range(60) for _ in range(2)]
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(records_)], "id long, data map<string,string>")
    model = forest.train_record_forest(m, trees=1, features=["rate"])
    got = {r.id: r.prediction for r in forest.predict(model, m, ("id",)).collect()}
    assert got == {i: (i // 2) % 2 for i in range(120)}
    with pytest.raises(ValueError, match="30"):
        forest.train_record_forest(m, trees=1, depth=31, features=["rate"])


def test_growth_is_as_deep_as_the_data_need(spark):
    # Feature j alone tells row group j apart, and each cut can only peel off one group.
    n = 45
    rows = [([1.0 if j == i else 0.0 for j in range(n)], i % 2) for i in range(n)]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    grown = nodes.grow_leaf(x, y, np.ones(n), 2, n, 1)
    parent = {c: r[0] for r in grown for c in r[3:5] if c is not None}
    depth = lambda i: 1 + depth(parent[i]) if i in parent else 0
    assert max(depth(r[0]) for r in grown) >= 20 and all(max(r[5]) == 1.0 for r in grown if r[1] is None)


@pytest.mark.parametrize("leaf_rows", [None, 40])
@pytest.mark.parametrize("trees", [1, 3])
def test_leaves_grow_to_purity(spark, leaf_rows, trees):
    rng = random.Random(7)
    rows = [([rng.random(), rng.randrange(3), rng.random()], rng.randrange(2)) for _ in range(300)]
    data = table_of(spark, rows)
    table = nodes.grow_to_purity(stump(spark, trees), data, 5, leaf_rows)
    leaves = table.where(F.col("feature").isNull()).collect()
    assert all(max(r.shares) == 1.0 for r in leaves) and {r.tree for r in leaves} == set(range(trees))
    assert table.groupBy("tree", "node").count().where("count > 1").isEmpty()
    if trees == 1:  # takes every row
        assert all(y == p for y, p in classes(table, data).values())
    else:  # each tree takes a sample of its own
        assert len({tuple(sorted((r.feature, r.threshold) for r in table.collect() if r.tree == t and r.feature is not None)) for t in range(trees)}) == trees


@pytest.mark.parametrize("leaf_rows", [None, 10])
def test_rows_that_are_alike_stay_together(spark, leaf_rows):
    rows = [([1.0, 2.0], i % 2) for i in range(30)] + [([5.0, 9.0], 1)] * 3 + [([5.0, 2.0], 0)] * 3
    data = table_of(spark, rows)
    table = nodes.grow_to_purity(stump(spark), data, 5, leaf_rows)
    got = classes(table, data)
    assert all(got[i][0] == got[i][1] for i in range(30, 36))
    assert any(r.feature is None and set(r.shares) == {0.5} for r in table.collect())


def test_nothing_to_grow(spark):
    data = table_of(spark, [([1.0], 0), ([2.0], 0)])
    assert nodes.grow_to_purity(stump(spark), data.limit(0), 1).count() == 1
    table = nodes.grow_to_purity(stump(spark), data, 1)
    assert [r.shares for r in table.collect()] == [[1.0, 0.0]]


def test_bag_weights_are_a_bootstrap():
    w = np.concatenate([nodes.bag_weights(np.arange(20_000), tree, 42) for tree in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.01 and abs(w.var() - 1) < 0.03
    assert (nodes.bag_weights(np.arange(100), 0, 1) != nodes.bag_weights(np.arange(100), 1, 1)).any()


def test_measured_nodes_against_brute_force(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(97), rng.randrange(3), rng.randrange(4000), rng.randrange(100)], rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame([([float(v) for v in x], y) for x, y in rows], "x array<double>, y int").repartition(3)
    measured = nodes.measure_nodes(forest_nodes(spark), df.select(array_to_vector("x").alias("features"), "y"), label="y")
    by = {(t, n): (f, cut, cats, left, right) for t, n, f, cut, cats, left, right, _ in FOREST}
    seen = {key: [0, 0] for key in by}
    for x, y in rows:
        for t in range(4):
            at = 0
            while at is not None:
                seen[t, at][y] += 1
                f, cut, cats, left, right = by[t, at]
                at = None if f is None else left if (x[f] in cats if cats else x[f] <= cut) else right
    gini = lambda c: 1 - sum((v / sum(c)) ** 2 for v in c)
    for r in measured.collect():
        c = seen[r.tree, r.node]
        assert r.weight == sum(c)
        if sum(c):
            assert r.shares == pytest.approx([v / sum(c) for v in c])
        if r.feature is not None and sum(c):
            sides = [seen[r.tree, r.left], seen[r.tree, r.right]]
            assert r.gain == pytest.approx(gini(c) - sum(sum(s) / sum(c) * gini(s) for s in sides if sum(s)))
    shares = [r.importance for r in nodes.node_importances(measured).collect()]
    assert sum(shares) == pytest.approx(1)


def test_node_forest_is_saved_and_evaluated(spark, log, tmp_path):
    out = str(tmp_path / "run")
    model = train_from_log(log, out, trees=6)
    assert isinstance(model, nodes.NodeForest) and model.getNumTrees == 6
    run = evaluate_log(spark, log, out).first()
    assert run["metrics"]["roc_auc"] > 0.95 and set(run["feature_names"]) >= set(FOREST_FEATURES)
    loaded = models.load_model(f"{out}/model")
    m = decode_records(records.split_scan(log, "testing"))
    a = {r.id: r.score for r in forest.score(model, m).collect()}
    assert a == {r.id: r.score for r in forest.score(loaded, m).collect()}
    models.save_model(forest.train_record_forest(decode_records(records.split_scan(log, "training")), 2, 3), f"{out}/model")
    assert not isinstance(models.load_model(f"{out}/model"), nodes.NodeForest)


def test_too_many_nodes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(nodes, "MAX_NODES", 10)
    with pytest.raises(ValueError, match="nodes"):
        nodes.NodeForest(forest_nodes(spark)).compiled
