"""Forests grown over coded rows: exact cuts, levels and tasks alike, and what is refused."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowsift.operators import forest, growth
from flowsift.operators.nodes import model_nodes
from flowsift.session import METHOD_LIMIT, small_methods


def frame(spark, x, y, parts=4):
    rows = [([float(v) for v in values], None if label is None else float(label)) for values, label in zip(x, y)]
    df = spark.createDataFrame(rows, "x array<double>, label double").repartition(parts)
    return df.select(array_to_vector("x").alias("features"), "label")


def by_levels(monkeypatch, **more):
    for name, value in {"HANDED_BYTES": 0, "HANDED_TIMES": 0, "BLOCK_ROWS": 100, **more}.items():
        monkeypatch.setattr(growth, name, value)


def noisy(n, width, seed, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (n, width)) / 8
    return x, np.where(rng.random(n) < 0.2, rng.integers(0, classes, n), (x[:, 0] + x[:, -1] > 5).astype(int))


def table(model):
    return {(r["tree"], r["node"]): r for r in model_nodes(model).collect()}


@pytest.mark.parametrize("levels", [True, False])
def test_cuts_between_any_two_values(spark, monkeypatch, levels):
    if levels:
        by_levels(monkeypatch, BINS=4)
    values = [i / 16 for i in range(2000)]
    random.Random(1).shuffle(values)
    df = frame(spark, [[v] for v in values], [77.12 < v < 101.3 for v in values])
    wrong = forest.train_forest(df, trees=1, depth=14).transform(df).where("prediction != label")
    assert wrong.count() == 0


def gini_kept(weights):
    return sum(w * w for w in weights) / sum(weights) if sum(weights) else 0.0


@pytest.mark.parametrize("levels", [True, False])
def test_every_cut_is_the_best_of_all(spark, monkeypatch, levels):
    """Of two features both are tried at each node: brute force finds no better cut, and leaves end for a reason."""
    if levels:
        by_levels(monkeypatch)
    x, y = noisy(600, 2, 3)
    found = table(forest.train_forest(frame(spark, x, y), trees=1, depth=5))
    share = np.bincount(y) / len(y)
    w = 1 / (2 * share[y])
    todo, seen = [(0, np.arange(len(y)), 0)], 0
    while todo:
        node, rows, depth = todo.pop()
        r, seen = found[0, node], seen + 1
        mass = np.bincount(y[rows], w[rows], 2)
        assert r["weight"] == pytest.approx(mass.sum()) and r["shares"] == pytest.approx(list(mass / mass.sum()))
        assert depth <= 5
        if r["feature"] is None:
            continue
        best = max(
            gini_kept(np.bincount(y[rows[a]], w[rows[a]], 2)) + gini_kept(np.bincount(y[rows[~a]], w[rows[~a]], 2))
            for f in (0, 1)
            for a in (x[rows, f] <= v for v in np.unique(x[rows, f])[:-1])
        )
        assert r["gain"] == pytest.approx((best - gini_kept(mass)) / mass.sum(), abs=1e-9)
        left = x[rows, r["feature"]] <= r["threshold"]
        todo += [(r["left"], rows[left], depth + 1), (r["right"], rows[~left], depth + 1)]
    assert seen == len(found) > 15


def test_passes_and_kept_places_do_not_change_the_forest(spark, monkeypatch):
    """Nodes in many passes, rows walked from the root or from where they stood: the same forest."""
    x, y = noisy(700, 5, 8, 3)
    df = frame(spark, x, y).persist()
    forests = []
    for fewer, held in ((math.inf, 64_000_000), (1, 64_000_000), (1, 100_000)):
        by_levels(monkeypatch, FEWER=fewer, COUNT_BYTES=held)
        model = growth.grow_forest(df, forest._forest(6, 4, 42), {0.0: 0.5, 1.0: 2.0})
        assert model.numClasses == 3 and max(t.depth for t in model.trees) == 4
        forests.append(table(model))
    df.unpersist()
    assert forests[0] == forests[1] == forests[2] and len(forests[0]) > 60


def test_trees_draw_rows_and_features_of_their_own(spark, monkeypatch, tmp_path):
    by_levels(monkeypatch, HANDED_BYTES=20_000)  # some levels, then tasks
    x, y = noisy(900, 6, 4)
    df = frame(spark, x, y)
    model = forest.train_forest(df, trees=15, depth=12)
    assert model.getNumTrees == 15 and model.numFeatures == 6
    roots = [r for (_, node), r in table(model).items() if node == 0]
    assert len({r["feature"] for r in roots}) > 1
    sums = [r["weight"] for r in roots]
    assert len(set(sums)) > 10 and np.mean(sums) == pytest.approx(900, rel=0.1)
    assert sum(model.featureImportances) == pytest.approx(1.0)
    assert model.transform(df).where("prediction = label").count() > 800  # grown deep, so that rows drawn are told apart
    model.save(str(tmp_path / "forest"))
    again = type(model).load(str(tmp_path / "forest"))
    assert table(again) == table(model) and again.getOrDefault("maxDepth") == 12


def test_quantiles_where_values_are_many(spark, monkeypatch):
    monkeypatch.setattr(growth, "MAX_CUTS", 20)
    df = frame(spark, [[float(i), 3.0] for i in range(1000)], [i > 499 for i in range(1000)])
    many, none = growth.cut_points(df, 1000, 1)
    assert 15 <= len(many) <= 20 and len(none) == 0 and (np.diff(many) > 0).all() and max(np.diff(many)) < 70
    monkeypatch.setattr(growth, "CUT_BYTES", 0)
    monkeypatch.setattr(growth, "LEAST_CUT_ROWS", 300)
    few, _ = growth.cut_points(df, 1000, 1)  # of drawn rows
    assert 15 <= len(few) <= 20


@pytest.mark.parametrize(
    "x, y", [([[1.0], [2.0]], [0, None]), ([[1.0], [2.0]], [0, 0.5]), ([[1.0], [2.0]], [-1, 1]), ([[1.0], [2.0]], [0, 0]),
             ([[1.0], [math.nan]], [0, 1]), ([[1.0], [math.inf]], [0, 1]), ([[1.0], [2.0, 3.0]], [0, 1])],
)
def test_rows_that_no_forest_takes(spark, x, y):
    with pytest.raises(Exception):
        forest.train_forest(frame(spark, x, y), trees=2, depth=2, weighted=False)


def test_categories_and_no_depth_stay_with_mllib(spark):
    df = frame(spark, [[i % 3] for i in range(90)], [i % 3 == 1 for i in range(90)])
    kinds = {"ml_attr": {"attrs": {"nominal": [{"idx": 0, "name": "c", "vals": ["a", "b", "c"]}]}, "num_attrs": 1}}
    marked = df.withColumn("features", F.col("features").alias("features", metadata=kinds))
    model = forest.train_forest(marked, trees=1, depth=1)  # one cut parts a set of categories
    assert model.transform(marked).where("prediction != label").count() == 0
    assert [t.depth for t in forest.train_forest(df, trees=3, depth=0).trees] == [0, 0, 0]


def test_the_limit_of_methods_comes_back(spark):
    before = spark.conf.get(METHOD_LIMIT)
    with pytest.raises(KeyError), small_methods(spark):
        assert spark.conf.get(METHOD_LIMIT) == "8000"
        raise KeyError
    assert spark.conf.get(METHOD_LIMIT) == before
