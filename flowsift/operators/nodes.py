"""Forests as tables of nodes: a row per node, read by any engine, grown without a depth limit.

MLlib grows trees level by level over all rows, to 30 levels and between a few cut points per
feature. What it leaves impure is handed over: rows in such leaves are dealt by (tree, leaf)
and each leaf is grown to purity inside a task, with every value a possible cut point. A leaf
with too many rows for a task is first split again by MLlib.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.session import fresh_path, written

#: A leaf has null feature, left and right. A value goes left if it is at most `threshold` or
#: one of `categories`. shares: of the classes; gain and weight: as MLlib counts them.
NODES = (
    "tree int, node long, feature int, threshold double, categories array<double>, "
    "left long, right long, shares array<double>, gain double, weight double"
)
#: Nodes that one broadcast holds (about 100 bytes each).
MAX_NODES = 10_000_000
#: Bytes of a leaf's rows that one task grows.
LEAF_BYTES = 64_000_000
MAX_DEPTH = 30  # the deepest tree MLlib can grow


def model_nodes(model: RandomForestClassificationModel | DecisionTreeClassificationModel) -> DataFrame:
    """The node table of a fitted forest or tree, read from its saved form by all tasks."""
    spark = SparkSession.active()
    path = fresh_path(spark, "forest")
    model.write().save(path)
    saved = spark.read.parquet(os.path.join(path, "data"))
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    cut = F.col("split.leftCategoriesOrThreshold")
    several = F.col("split.numCategories") >= 0
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return saved.select(
        F.col("tree").cast("int"),
        F.col("id").cast("long").alias("node"),
        F.when(inner, F.col("split.featureIndex")).cast("int").alias("feature"),
        F.when(inner & ~several, cut[0]).alias("threshold"),
        F.when(inner & several, cut).alias("categories"),
        F.when(inner, F.col("leftChild")).cast("long").alias("left"),
        F.when(inner, F.col("rightChild")).cast("long").alias("right"),
        F.transform("impurityStats", lambda x: F.try_divide(x, total)).alias("shares"),
        F.when(inner, F.col("gain")).alias("gain"),
        total.alias("weight"),
    )


@dataclasses.dataclass
class Compiled:
    """Nodes as arrays; trees[i] is the place of a root, children are places, -1 marks a leaf."""

    trees: np.ndarray
    tree: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray
    categories: dict[int, np.ndarray]

    def __post_init__(self):
        # Every (place, category) that goes left as one sorted number, to look up all rows of a level at once.
        self.width = 1 + int(max((c.max() for c in self.categories.values() if len(c)), default=0))
        self.listed = np.sort(np.concatenate([[], *(p * self.width + c for p, c in self.categories.items())]).astype(np.int64))

    def _listed(self, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Whether each value is among the categories of its place."""
        known = (value >= 0) & (value < self.width) & (value == np.floor(value))
        key = place * self.width + np.where(known, value, 0).astype(np.int64)
        at = np.minimum(np.searchsorted(self.listed, key), len(self.listed) - 1)
        return known & (self.listed[at] == key) if len(self.listed) else known & False

    def walk(self, root: int, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Level by level, the places that rows stand at and the numbers of those rows; each row until its leaf."""
        who, here = np.arange(len(x)), np.full(len(x), root)
        while len(who):
            yield here, who
            inner = self.left[here] >= 0
            who, here = who[inner], here[inner]
            value = x[who, self.feature[here]]
            goes_left = value <= self.threshold[here]
            if self.categories:
                some = np.flatnonzero(np.isnan(self.threshold[here]))
                goes_left[some] = self._listed(here[some], value[some])
            here = np.where(goes_left, self.left[here], self.right[here])

    def leaves(self, root: int, x: np.ndarray) -> np.ndarray:
        """The place of the leaf that each row reaches."""
        at = np.full(len(x), root)
        for here, who in self.walk(root, x):
            at[who] = here
        return at


def compile_nodes(nodes: DataFrame) -> Compiled:
    """The node table on the driver, at most MAX_NODES rows of it; more are an error."""
    count = nodes.count()
    if count > MAX_NODES:
        raise ValueError(f"a forest of {count} nodes does not fit a broadcast of {MAX_NODES}")
    rows = nodes.orderBy("tree", "node").toArrow()
    column = {n: rows[n].combine_chunks() for n in rows.column_names}
    number = lambda n, fill, kind: column[n].fill_null(fill).to_numpy(zero_copy_only=False).astype(kind)
    tree, node = number("tree", 0, np.int64), number("node", 0, np.int64)
    left, right = number("left", -1, np.int64), number("right", -1, np.int64)
    # (tree, node) is the row order: a child's place is found inside its tree.
    first = np.flatnonzero(np.diff(tree, prepend=tree[:1] - 1)) if count else np.zeros(0, np.int64)
    ends = np.append(first[1:], count)
    for a, b in zip(first, ends):
        for child in (left, right):
            inner = np.flatnonzero(child[a:b] >= 0) + a
            child[inner] = a + np.searchsorted(node[a:b], child[inner])
    lists = column["categories"]
    some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    categories = {int(i): np.array(lists[int(i)].as_py()) for i in some}
    classes = max((len(s) for s in column["shares"][:1].to_pylist()), default=2)
    shares = column["shares"].flatten().to_numpy(zero_copy_only=False).reshape(count, classes)
    threshold = column["threshold"].to_numpy(zero_copy_only=False).astype(float)
    return Compiled(first, tree, node, number("feature", 0, np.int64), threshold, left, right, shares, categories)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


class NodeForest:
    """A forest held as a node table, used like a fitted pipeline.

    front: the stages that make the vector column `features` from raw rows (None: it is there).
    """

    def __init__(self, nodes: DataFrame, front: PipelineModel | None = None):
        self.nodes, self.front = nodes, front or PipelineModel([])

    @functools.cached_property
    def compiled(self) -> Compiled:
        return compile_nodes(self.nodes)

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - the name that a fitted MLlib forest gives it
        return len(self.compiled.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with features, probability and prediction (the likeliest class, the smaller of equal ones).

        As in MLlib, probability sums the shares of the leaves that a row reaches, brought to 1.
        """
        shared = df.sparkSession.sparkContext.broadcast(self.compiled)

        @F.arrow_udf("array<double>")
        def shares(features: pa.Array) -> pa.Array:
            forest, x = shared.value, _matrix(features)
            raw = np.zeros((len(x), forest.shares.shape[1]))
            for root in forest.trees.tolist():
                raw += forest.shares[forest.leaves(root, x)]
            p = raw / raw.sum(axis=1, keepdims=True)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

        vectors = self.front.transform(df)
        vectors = vectors.select(*dict.fromkeys([*df.columns, "features"]))
        scored = vectors.withColumn("probability", shares(vector_to_array("features")))
        likeliest = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumn("prediction", likeliest.cast("double")).withColumn("probability", array_to_vector("probability"))


def node_importances(nodes: DataFrame) -> DataFrame:
    """(slot, importance): each feature's share of its tree's weighted gains, averaged over trees with any."""
    gains = nodes.where(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    total = gains.groupBy("tree").agg(F.sum("g").alias("t")).where("t > 0")  # one row per tree
    shares = gains.join(F.broadcast(total), "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("s"))
    all_of = shares.agg(F.sum("s")).scalar()
    return shares.select(F.col("feature").alias("slot"), (F.col("s") / all_of).alias("importance"))


def measure_nodes(nodes: DataFrame, rows: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """The node table with shares, gain and weight as `rows` give them; a node that no row reaches keeps its shares.

    A task counts the classes of its rows at every node they pass; what is shuffled is one row
    per task, node and class.
    """
    forest = NodeForest(nodes)
    compiled = forest.compiled
    shared = rows.sparkSession.sparkContext.broadcast(compiled)
    classes = compiled.shares.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        seen = np.zeros((len(found.node), classes), np.int64)
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for root in found.trees.tolist() if len(x) else []:
                for at, who in found.walk(root, x):
                    np.add.at(seen, (at, y[who]), 1)
        at, label = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.tree[at], pa.int32()), pa.array(found.node[at]), pa.array(label, pa.int32()), pa.array(seen[at, label])],
            names=["tree", "node", "label", "n"],
        )

    slim = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull())
    counts = slim.mapInArrow(count, "tree int, node long, label int, n long").groupBy("tree", "node")
    per_class = [F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).cast("double") for c in range(classes)]
    seen = written(counts.agg(F.array(*per_class).alias("c")), "node-counts")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    # n * (1 - impurity): the sum of squares over the rows.
    squares = lambda c: F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda a, x: a + x) / total(c)
    side = lambda s: seen.select(F.col("tree"), F.col("node").alias(s), F.col("c").alias(f"c_{s}"))
    joined = nodes.join(seen, ["tree", "node"], "left").join(side("left"), ["tree", "left"], "left").join(side("right"), ["tree", "right"], "left")
    kept = F.coalesce(squares(F.col("c_left")), F.lit(0.0)) + F.coalesce(squares(F.col("c_right")), F.lit(0.0))
    gain = F.when(F.col("feature").isNotNull(), F.coalesce((kept - squares(F.col("c"))) / total(F.col("c")), F.lit(0.0)))
    return joined.select(
        "tree", "node", "feature", "threshold", "categories", "left", "right",
        F.coalesce(F.transform("c", lambda x: x / total(F.col("c"))), "shares").alias("shares"),
        gain.alias("gain"),
        F.coalesce(total(F.col("c")), F.lit(0.0)).alias("weight"),
    )


# ---- growing leaves to purity ------------------------------------------------

_ROUTED = "tree int, leaf long, row long, label int, weight double, x array<double>"


def bag_weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a row is drawn into a tree's sample: Poisson(1) by a hash of row, tree and seed."""
    h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0x2545F491 + seed) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # a public 64-bit mixer
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    chances = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    return np.searchsorted(chances, u, "right").astype(np.float64)


def _route(rows: DataFrame, compiled: Compiled, seed: int) -> DataFrame:
    """Rows (row, label, weight, x) at every impure leaf they reach, with their weight in its tree; others are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(compiled)
    bagged = len(compiled.trees) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        impure = (forest.left < 0) & ((forest.shares > 0).sum(axis=1) > 1)
        for batch in batches:
            row, label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = _matrix(batch.column(3))
            for root in forest.trees.tolist() if len(x) else []:
                tree = int(forest.tree[root])
                leaf = forest.leaves(root, x)
                who = np.flatnonzero(impure[leaf])
                drawn = weight[who] * bag_weights(row[who], tree, seed) if bagged else weight[who]
                who, drawn = who[drawn > 0], drawn[drawn > 0]
                if len(who):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(who), tree, np.int32)), pa.array(forest.node[leaf[who]]), pa.array(row[who]),
                            pa.array(label[who]), pa.array(drawn), batch.column(3).take(pa.array(who)),
                        ],
                        names=["tree", "leaf", "row", "label", "weight", "x"],
                    )

    return rows.select("row", "label", "weight", "x").mapInArrow(run, _ROUTED)


def _best_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, counts: np.ndarray, tried: int, rng) -> tuple | None:
    """(feature, threshold, gain) of the best cut among `tried` features that vary, or None if none does."""
    varying = np.flatnonzero(x.min(axis=0) < x.max(axis=0))
    total, best = counts.sum(), None
    for feature in rng.permutation(varying)[:tried].tolist():
        order = np.argsort(x[:, feature], kind="stable")
        value = x[order, feature]
        weights = np.zeros((len(order), len(counts)))
        weights[np.arange(len(order)), y[order]] = w[order]
        at = np.flatnonzero(value[1:] > value[:-1])
        left = np.cumsum(weights, axis=0)[at]
        right = counts - left
        pure = (left**2).sum(axis=1) / left.sum(axis=1) + (right**2).sum(axis=1) / right.sum(axis=1)
        i = int(np.argmax(pure))
        if best is None or pure[i] > best[0]:
            low, high = value[at[i]], value[at[i] + 1]
            middle = low + (high - low) / 2
            best = (pure[i], feature, middle if low <= middle < high else low)
    if best is None:
        return None
    return best[1], float(best[2]), max(0.0, float(best[0] / total - (counts**2).sum() / total**2))


def grow_leaf(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tried: int, seed: int, depth: int | None = None) -> list[tuple]:
    """The nodes of a tree that parts the rows until every leaf is pure, its rows are alike, or `depth` levels are reached.

    (number, feature, threshold, left, right, shares, gain, weight); the root is number 0. NaN
    is larger than every number, as it goes right.
    """
    x, rng = np.where(np.isnan(x), np.inf, x), np.random.default_rng(seed)
    out, todo, known = [], [(0, np.arange(len(x)), 0)], 1
    while todo:
        number, rows, level = todo.pop()
        counts = np.bincount(y[rows], w[rows], classes)
        ends = (counts > 0).sum() < 2 or level == depth
        cut = None if ends else _best_cut(x[rows], y[rows], w[rows], counts, tried, rng)
        children = (None, None) if cut is None else (known, known + 1)
        out.append((number, *(cut or (None,) * 3)[:2], *children, (counts / counts.sum()).tolist(), cut and cut[2], float(counts.sum())))
        if cut is not None:
            known += 2
            goes_left = x[rows, cut[0]] <= cut[1]
            todo += [(children[0], rows[goes_left], level + 1), (children[1], rows[~goes_left], level + 1)]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches -> the rows of one (tree, leaf) at a time."""
    held: list[pa.RecordBatch] = []
    key = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, leaf = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = [0, *(np.flatnonzero((np.diff(tree) != 0) | (np.diff(leaf) != 0)) + 1).tolist(), len(tree)]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            if held and key(held[0], 0) != key(part, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _grow(routed: DataFrame, classes: int, seed: int, parts: int | None = None) -> DataFrame:
    """Node rows of every (tree, leaf): its root keeps the leaf's number, others follow from it.

    A column `room` has the levels that a leaf may still grow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            tree, leaf = group["tree"][0].as_py(), group["leaf"][0].as_py()
            x = _matrix(group["x"].combine_chunks())
            y, w = (group[n].combine_chunks().to_numpy(zero_copy_only=False) for n in ("label", "weight"))
            tried = max(1, math.ceil(math.sqrt(x.shape[1])))
            room = group["room"][0].as_py() if "room" in group.column_names else None
            rows = grow_leaf(x, y, w, classes, tried, hash((seed, tree, leaf)) & 0xFFFFFFFF, room)
            name = lambda i: leaf if i == 0 else ((leaf + 1) << 32) + i
            number, feature, threshold, left, right, shares, gain, weight = zip(*rows)
            named = lambda ids: pa.array([None if i is None else name(i) for i in ids], pa.int64())
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree] * n, pa.int32()), named(number), pa.array(feature, pa.int32()), pa.array(threshold, pa.float64()),
                    pa.nulls(n, pa.list_(pa.float64())), named(left), named(right), pa.array(shares, pa.list_(pa.float64())),
                    pa.array(gain, pa.float64()), pa.array(weight, pa.float64()),
                ],
                names=[c.split()[0] for c in NODES.split(", ")],
            )

    dealt = routed.repartition(*([parts] if parts else []), "tree", "leaf").sortWithinPartitions("tree", "leaf", "row")
    return dealt.mapInArrow(run, NODES)


def _split_again(rows: DataFrame, tree: int, leaf: int, free: int) -> DataFrame | None:
    """Nodes that part the many rows of one leaf, numbered from `free` on but for the root; None if all rows are alike."""
    data = rows.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), "weight")
    grown = model_nodes(DecisionTreeClassifier(maxDepth=MAX_DEPTH, maxBins=256, weightCol="weight").fit(data))
    if grown.count() == 1:  # no cut of MLlib's helps: the middle of the widest feature parts the rows at least
        span = data.agg(Summarizer.min(F.col("features")).alias("low"), Summarizer.max(F.col("features")).alias("high")).first()
        low, high = span["low"].toArray(), span["high"].toArray()
        if not (low < high).any():
            return None
        at = int(np.argmax(high / 2 - low / 2))
        middle = low[at] + (high[at] - low[at]) / 2
        cut = float(middle if middle < high[at] else low[at])
        classes = len(grown.first()["shares"])
        sums = rows.groupBy((F.col("x")[at] <= cut).alias("left"), "label").agg(F.sum("weight").alias("w")).collect()
        sides = [[sum(r["w"] for r in sums if r["left"] == side and r["label"] == c) for c in range(classes)] for side in (True, False)]
        leaf_row = lambda i, w: (0, i, None, None, None, None, None, [v / sum(w) for v in w], None, float(sum(w)))
        both = [float(a + b) for a, b in zip(*sides)]
        pure = lambda w: sum(v * v for v in w) / sum(w)
        gain = max(0.0, (pure(sides[0]) + pure(sides[1]) - pure(both)) / sum(both))
        root = (0, 0, at, cut, None, 1, 2, [v / sum(both) for v in both], gain, sum(both))
        grown = rows.sparkSession.createDataFrame([root, leaf_row(1, sides[0]), leaf_row(2, sides[1])], NODES)
    name = lambda c: F.when(F.col(c) == 0, F.lit(leaf)).when(F.col(c) > 0, F.col(c) + F.lit(free)).alias(c)
    columns = [c.split()[0] for c in NODES.split(", ")]
    return grown.withColumn("tree", F.lit(tree)).select(*[name(c) if c in ("node", "left", "right") else c for c in columns])


def grow_to_purity(nodes: DataFrame, rows: DataFrame, seed: int, leaf_rows: int | None = None) -> DataFrame:
    """The node table with every impure leaf grown until its rows are of one class or alike.

    rows: (row long, label int, weight double, x array<double> of finite numbers), written down. Several trees each
    draw rows anew for their leaves; a single tree takes all. Rows are dealt by (tree, leaf); a
    leaf of more than `leaf_rows` (by default what 64 MB hold) is first split again over all tasks.
    """
    first = rows.select(F.size("x")).first()
    if first is None:
        return nodes
    leaf_rows = leaf_rows or max(1, LEAF_BYTES // (8 * first[0] + 32))
    replaced, alike = written(nodes, "nodes"), []
    while True:
        compiled = compile_nodes(replaced)
        routed = written(_route(rows, compiled, seed), "routed")
        for tree, leaf in alike:
            routed = routed.where((F.col("tree") != tree) | (F.col("leaf") != leaf))
        counts = routed.groupBy("tree", "leaf").count()
        large = counts.where(F.col("count") > leaf_rows).collect()  # rows * trees / leaf_rows at most
        if not large:
            break
        for tree, leaf, _ in large:
            free = int(compiled.node[compiled.tree == tree].max()) + 1
            here = (F.col("tree") == tree) & (F.col("leaf") == leaf)
            more = _split_again(routed.where(here), tree, leaf, free)
            if more is None:
                alike.append((tree, leaf))
                continue
            kept = replaced.where((F.col("tree") != tree) | (F.col("node") != leaf))
            replaced = written(kept.unionByName(more), "nodes")
            compiled = compile_nodes(replaced)
    grown = written(_grow(routed, compiled.shares.shape[1], seed), "grown")
    roots = grown.select("tree", "node")
    return written(replaced.join(roots, ["tree", "node"], "left_anti").select(grown.columns).unionByName(grown), "nodes")
