"""Centroid clustering in whole numbers, with a vantage-point tree over the centroids.

Each round builds the tree over the current centroids, broadcasts it (centroids times
components numbers, whatever the table's size) and lets every vector search it best first:
the node with the smallest lower bound is opened next, until no bound is below or at the
best squared distance found. The vectors of a batch take their steps together. Bounds are
floating-point numbers moved outwards by a margin above their error; distances to
centroids are exact integers, and of equal ones the smaller centroid number wins.
"""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.common import store

#: Scaled components lie below this in size, so that squared distances of DIMENSIONS fit a long.
LIMIT = 1 << 27
DIMENSIONS = 64
LEAF = 4
#: Relative margin by which a bound gives way; errors of the float square roots are near 1e-16.
MARGIN = 1e-9
#: Vectors that take their steps together; their arrays hold some 1,000 bytes each.
STEP_ROWS = 4096


@dataclasses.dataclass
class Tree:
    """Nodes in arrays. A leaf lists its centroids; an inner node has a vantage centroid,
    which is evaluated when the node is opened, and two children with the range of distances
    from the vantage centroid to theirs."""

    centroids: np.ndarray
    vantage: np.ndarray  # -1: leaf
    children: np.ndarray  # (nodes, 2)
    low: np.ndarray  # (nodes, 2): least distance from the vantage centroid into each child
    high: np.ndarray
    members: list[np.ndarray]  # of leaves


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to one centroid."""
    d = vectors - centroid
    return np.einsum("ij,ij->i", d, d)


def build_tree(centroids: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over all centroids; the vantage centroid of a node is the one farthest from its first."""
    vantage, children, low, high, members = [], [], [], [], []

    def grow(ids: np.ndarray) -> int:
        node = len(vantage)
        vantage.append(-1)
        children.append((-1, -1))
        low.append((0.0, 0.0))
        high.append((0.0, 0.0))
        members.append(ids)
        if len(ids) <= max(leaf, 2):
            return node
        at = int(np.argmax(squared(centroids[ids], centroids[ids[0]])))
        vantage[node], members[node] = int(ids[at]), ids[:0]
        rest = np.delete(ids, at)
        far = np.sqrt(squared(centroids[rest], centroids[ids[at]]).astype(np.float64))
        order = np.argsort(far, kind="stable")
        near, away = order[: len(order) // 2], order[len(order) // 2 :]
        low[node] = tuple(float(far[s].min()) for s in (near, away))
        high[node] = tuple(float(far[s].max()) for s in (near, away))
        children[node] = (grow(rest[near]), grow(rest[away]))
        return node

    grow(np.arange(len(centroids)))
    return Tree(centroids, np.array(vantage), np.array(children), np.array(low), np.array(high), members)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, exact squared distance) of the nearest centroid of every vector."""
    rows, nodes = len(vectors), len(tree.vantage)
    best = np.full(rows, np.iinfo(np.int64).max)
    cluster = np.full(rows, len(tree.centroids))
    bound = np.full((rows, nodes), np.inf)  # of nodes that wait to be opened; a bound on the distance
    bound[:, 0] = 0.0

    def offer(who: np.ndarray, centroid: int) -> np.ndarray:
        d = squared(vectors[who], tree.centroids[centroid])
        better = (d < best[who]) | ((d == best[who]) & (centroid < cluster[who]))
        best[who[better]], cluster[who[better]] = d[better], centroid
        return d

    active = np.arange(rows)
    while len(active):
        node = np.argmin(bound[active], axis=1)
        least = bound[active, node]
        # Inclusive: a node whose bound equals the best distance may hold an equal, smaller number.
        radius = np.sqrt(best[active].astype(np.float64)) * (1 + MARGIN)
        going = least <= radius
        active, node = active[going], node[going]
        bound[active, node] = np.inf
        for one in np.unique(node):
            who = active[node == one]
            if tree.vantage[one] < 0:
                for centroid in tree.members[one]:
                    offer(who, int(centroid))
                continue
            distance = np.sqrt(offer(who, int(tree.vantage[one])).astype(np.float64))
            for side, child in enumerate(tree.children[one]):
                gap = np.maximum(tree.low[one, side] - distance, distance - tree.high[one, side])
                slack = MARGIN * (distance + tree.high[one, side])
                bound[who, child] = np.maximum(np.maximum(gap - slack, 0.0), least[going][node == one])
    return cluster, best


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null unless it has DIMENSIONS finite ones within LIMIT."""
    numbers = F.transform(vector.cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    within = F.forall(numbers, lambda x: F.coalesce((x >= F.lit(float(-LIMIT))) & (x < F.lit(float(LIMIT))), F.lit(False)))
    whole = F.transform(numbers, lambda x: F.floor(x))
    return F.when((F.size(vector) == DIMENSIONS) & within, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), DIMENSIONS)


def _search(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [nearest(tree, vectors[i : i + STEP_ROWS]) for i in range(0, len(vectors), STEP_ROWS)]
    clusters, distances = zip(*parts) if parts else ([np.zeros(0, int)], [np.zeros(0, int)])
    return np.concatenate(clusters), np.concatenate(distances)


def _first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The components of the k vectors with the smallest sha256("<seed>:<vec_id>"), in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k)
    return np.array([r["vector"] for r in first.collect()], np.int64).reshape(-1, DIMENSIONS)


def _round(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; a cluster without vectors stays.

    A task adds up its vectors and gives one row per cluster; the driver gets one per cluster.
    """
    spark = kept.sparkSession
    shared = spark.sparkContext.broadcast(build_tree(centroids))

    def add(batches):
        sums = np.zeros((len(centroids), DIMENSIONS + 1), np.int64)  # number of vectors, then components
        for batch in batches:
            vectors = _matrix(batch.column(0))
            cluster, _ = _search(shared.value, vectors)
            order = np.argsort(cluster, kind="stable")
            found, start, counts = np.unique(cluster[order], return_index=True, return_counts=True)
            if len(found):
                sums[found, 0] += counts
                sums[found, 1:] += np.add.reduceat(vectors[order], start, axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"]
        )

    parts = kept.select("vector").mapInArrow(add, "cluster int, sums array<long>")
    each = parts.select("cluster", F.posexplode("sums").alias("at", "part"))
    total = each.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    rows: dict[int, dict[int, int]] = {}
    for r in total.collect():  # at most k * (DIMENSIONS + 1)
        rows.setdefault(r["cluster"], {})[r["at"]] = int(r["total"])
    for cluster, sums in rows.items():
        if sums[0]:
            out[cluster] = [sums[i + 1] // sums[0] for i in range(DIMENSIONS)]
    shared.destroy()
    return out


def cluster_vectors(
    df: DataFrame, id_col: str, vector_col: str, k: int = 40, rounds: int = 5, seed: str = "2", scale: int = 256
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly 64 components, none null or non-finite; components that
    scale beyond 2^27 in size would give distances that no long holds, and their vectors are left
    out as well. An inertia that no long holds is null. With fewer than k kept vectors there are as many centroids. Repeated rows keep rows of
    their own; equal first centroids, by repeated ids or vectors, all exist and the smaller number wins
    their vectors; a null vec_id draws as the empty string; other columns play no part; no kept
    vector, no rows. The scaled vectors are written once to the shared folder, and every
    round reads them from there: a lost executor costs its tasks of one round.
    """
    vector = scaled(F.col(f"`{vector_col}`"), scale).alias("vector")
    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector)
    kept, _ = store(picked.where(F.col("vector").isNotNull()), "scaled-vectors")
    centroids = _first_centroids(kept, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _round(kept, centroids)
    shared = df.sparkSession.sparkContext.broadcast(build_tree(centroids))

    def assign(batches):
        for batch in batches:
            cluster, distance = _search(shared.value, _matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    assigned, _ = store(kept.mapInArrow(assign, schema), "assigned-vectors")
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    sums = {r["cluster"]: int(r["cluster_inertia"]) for r in inertia.collect()}  # at most k
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    long = lambda x: x if x < 1 << 63 else None
    rows = [(c, long(s), long(sum(sums.values())), hashes[c]) for c, s in sums.items()]
    per_cluster = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
