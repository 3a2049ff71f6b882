"""Centroid clustering against brute force, and its edge cases."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from flowsift.llm import centroids
from flowsift.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, vector string, cluster string, distance string"


def brute_nearest(points, at):
    d = ((points[:, None, :] - at[None, :, :]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)  # the first of equal ones


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 200), st.integers(1, 4), st.integers(1, 5), st.integers(0, 2**31))
def test_tree_search_with_ties(k, n, spread, leaf, seed):
    rng = np.random.default_rng(seed)  # few distinct values: many equal distances and equal centroids
    at = rng.integers(-spread, spread + 1, (k, 64)) * rng.integers(0, 2, (k, 64))
    points = np.concatenate((rng.integers(-spread, spread + 1, (n, 64)), at))
    cluster, distance = centroids.nearest(centroids.build_tree(at, leaf), points)
    want, least = brute_nearest(points, at)
    assert (cluster == want).all() and (distance == least).all()


def test_tree_search_at_the_limit():
    rng = np.random.default_rng(3)
    at = rng.integers(-centroids.LIMIT, centroids.LIMIT, (40, 64))
    at[:3] = [[-centroids.LIMIT], [centroids.LIMIT - 1], [0]]
    points = np.concatenate((rng.integers(-centroids.LIMIT, centroids.LIMIT, (300, 64)), at))
    cluster, distance = centroids.nearest(centroids.build_tree(at), points)
    want, least = brute_nearest(points, at)
    assert (cluster == want).all() and (distance == least).all()


def test_clustered_vectors_open_few_nodes():
    rng = np.random.default_rng(5)
    at = rng.integers(-4000, 4000, (200, 64))
    points = at[rng.integers(0, 200, 3000)] + rng.integers(-30, 30, (3000, 64))
    seen = []
    plain = centroids.squared
    try:
        centroids.squared = lambda v, c: (seen.append(len(v)), plain(v, c))[1]
        tree = centroids.build_tree(at)
        seen.clear()
        cluster, _ = centroids.nearest(tree, points)
    finally:
        centroids.squared = plain
    assert (cluster == brute_nearest(points, at)[0]).all()
    assert sum(seen) < 0.5 * len(points) * len(at)


def brute(rows, k=40, rounds=5):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and math.isfinite(x) for x in vector):
            whole = [math.floor(256 * float(np.float32(x))) for x in vector]
            if all(-centroids.LIMIT <= x < centroids.LIMIT for x in whole):
                kept.append((vec_id, whole))
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    points = np.array([v for _, v in kept], object)

    def assign():
        return [min(((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(at))) for p in points.tolist()]

    for _ in range(rounds):
        groups = {}
        for p, (_, j) in zip(points.tolist(), assign()):
            groups.setdefault(j, []).append(p)
        for j, g in groups.items():
            at[j] = [sum(c) // len(g) for c in zip(*g)]
    found = assign()
    each = {j: sum(d for d, i in found if i == j) for _, j in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, j, d, each[j], sum(each.values()), sha[j]) for (i, _), (d, j) in zip(kept, found)]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("k", [1, 7, 40])
def test_odd_rows(spark, k):
    rng = np.random.default_rng(k)
    far = [float(x) for x in rng.integers(-8, 8, 64)]
    rows = [(i, [float(x) for x in rng.normal(0, 1, 64)]) for i in range(30)]
    rows += [(100, far), (100, far), (101, far), (None, far), (None, None), (102, None), (103, []), (104, far[:63])]
    rows += [(105, [*far[:63], None]), (106, [*far[:63], math.nan]), (107, [math.inf, *far[:63]]), (108, [0.0] * 64)]
    rows += [(109, [1e30, *far[:63]]), (110, [*far, 1.0]), (111, [-0.001] * 64)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = centroids.cluster_vectors(df, "vec_id", "embedding", k).collect()
    assert order(got) == order(brute(rows, k))


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, "", "", "")], SCHEMA)
    for frame in (df, df.limit(0)):
        out = centroids.cluster_vectors(frame, "vec_id", "embedding")
        assert out.count() == 0 and out.columns[-1] == "centroid_sha256"


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert order(QUERIES["op13_centroids"](spark, sf).collect()) == order(brute(rows))
