"""Growth of a forest over coded rows: all trees a level at a time, then small nodes inside tasks.

Every value becomes a code once, its place among the cut points of its feature, and rows are
written as blocks of codes. A level of all trees is one pass: tasks walk their rows to the
nodes that may still be parted, count classes by bins of codes, and the counts of a node meet
in one task that finds its cut. A node's bins span only the codes that the cuts above it leave,
so that deeper nodes are cut finer. Rows of pure leaves are left out of all counts. Nodes whose
rows a task holds are dealt by (tree, node) and grown to the end there, every code a possible cut.
"""

from __future__ import annotations

import dataclasses
import json
import math
import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.operators.nodes import LEAF_BYTES, _grow, _matrix
from flowsift.session import fresh_path, small_methods, written

#: Cut points of a feature; a code is a 16-bit number.
MAX_CUTS = 32_766
#: Bytes of the rows that give the cut points (MLlib draws 10,000 rows); all rows where they are fewer.
CUT_BYTES, LEAST_CUT_ROWS = 16_000_000, 10_000
#: Bytes of a block's codes, and its most rows.
BLOCK_BYTES, BLOCK_ROWS = 2_000_000, 16_384
#: Bins of a feature at a node.
BINS = 256
#: Bytes of the counts that one task holds.
COUNT_BYTES = 64_000_000
#: Where rows stand is written once so many times fewer are looked at than in the blocks.
FEWER = 8
#: Bytes of the rows that are dealt to tasks by node: at least these, or so many times the coded rows.
HANDED_BYTES, HANDED_TIMES = 256_000_000, 2
#: A cut must lessen the impurity by more than rounding does.
LEAST_GAIN = 1e-12
#: Model nodes that are written at once.
NODES_AT_ONCE = 1_000_000

_BLOCKS = "block long, codes binary, labels binary, standing binary"
_COUNTS = "slot int, counts binary"
_CUTS = "slot int, place int, bin int, gain double, near array<long>, far array<long>"
_ROUTED = "tree int, leaf long, row long, label int, weight double, x array<short>, room int"
#: How often a row is drawn, Poisson(1), for every 16-bit number.
_DRAWN = np.searchsorted(
    np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)]), (np.arange(65_536) + 0.5) / 65_536, "right"
).astype(np.uint8)


# ---- rows as codes -----------------------------------------------------------


def cut_points(data: DataFrame, count: int, seed: int) -> list[np.ndarray]:
    """The cut points of each feature: between all values of the rows looked at, or as many of their quantiles as codes allow."""
    x = vector_to_array("features").alias("x")
    width = data.select(F.size(x)).first()[0]
    most = max(LEAST_CUT_ROWS, CUT_BYTES // (8 * max(1, width)))
    # Inside the case, rows that are not drawn need no vector.
    drawn = data.select(x) if count <= most else data.select(F.when(F.rand(seed) < most / count, x).alias("x")).where("x IS NOT NULL")
    values = _matrix(drawn.toArrow()["x"].combine_chunks())
    cuts = []
    for i in range(width):
        v, n = np.unique(values[:, i], return_counts=True)
        if len(v) > MAX_CUTS:
            v_ends = np.diff(np.cumsum(n) * MAX_CUTS // len(values), prepend=0) > 0
            v_ends[-1] = False
        else:
            v_ends = np.arange(len(v)) < len(v) - 1
        low, high = v[:-1][v_ends[:-1]], v[1:][v_ends[:-1]]
        middle = low + (high - low) / 2
        cuts.append(np.where((low <= middle) & (middle < high), middle, low))
    return cuts


def coded_rows(data: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(features, label) as blocks: codes row after row, labels, and a number that stays with the block."""
    shared = data.sparkSession.sparkContext.broadcast(cuts)
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (2 * max(1, len(cuts)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, part, made, held, rows = shared.value, TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            codes, labels = (np.concatenate(parts).tobytes() for parts in zip(*held))
            return _block((part << 24) + made, codes, labels, None)

        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int16)
            if batch.column(1).null_count:
                raise ValueError("a row's features are null")
            x = _matrix(batch.column(1))
            if x.shape[1] != len(cuts) or not np.isfinite(x).all():
                raise ValueError(f"features must be vectors of {len(cuts)} finite numbers")
            codes = np.empty(x.shape, np.int16)
            for i, c in enumerate(cuts):
                codes[:, i] = np.searchsorted(c, x[:, i], "left")
            at = 0
            while at < len(y):
                some = min(most - rows, len(y) - at)
                held.append((codes[at : at + some], y[at : at + some]))
                at, rows = at + some, rows + some
                if rows == most:
                    yield block()
                    made, held, rows = made + 1, [], 0
        if held:
            yield block()

    return written(data.select("label", vector_to_array("features").alias("x")).mapInArrow(run, _BLOCKS), "codes")


def _block(*values: int | bytes | None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "codes", "labels", "standing"])


@dataclasses.dataclass
class Block:
    """Rows as codes and labels; `standing` has, tree by tree, the rows still looked at, their nodes and how often they are drawn."""

    number: int
    codes: np.ndarray
    labels: np.ndarray
    ends: np.ndarray | None = None
    row: np.ndarray | None = None
    node: np.ndarray | None = None
    drawn: np.ndarray | None = None

    @property
    def width(self) -> int:
        return len(self.codes) // max(1, len(self.labels))

    @classmethod
    def read(cls, batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[Block]:
        for batch in batches:
            for number, codes, labels, standing in zip(*batch.columns):
                codes, labels = (np.frombuffer(v.as_buffer(), np.int16) for v in (codes, labels))
                block = cls(number.as_py(), codes, labels.astype(np.int64))
                if standing.is_valid:
                    data = standing.as_buffer()
                    block.ends = np.frombuffer(data, np.int32, trees)
                    n = int(block.ends[-1])
                    block.node = np.frombuffer(data, np.int32, n, 4 * trees)
                    block.row = np.frombuffer(data, np.int16, n, 4 * (trees + n))
                    block.drawn = np.frombuffer(data, np.uint8, n, 4 * (trees + n) + 2 * n)
                yield block

    def rows_of(self, tree: int, seed: int, bagged: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that a tree looks at, the nodes they stand at, and how often it draws them."""
        if self.ends is not None:
            a, b = int(self.ends[tree - 1]) if tree else 0, int(self.ends[tree])
            return self.row[a:b].astype(np.int64), self.node[a:b].astype(np.int64), self.drawn[a:b]
        if not bagged:
            return np.arange(len(self.labels)), np.full(len(self.labels), tree), np.ones(len(self.labels), np.uint8)
        drawn = _DRAWN[np.random.default_rng([seed, self.number, tree]).integers(0, 65_536, len(self.labels), np.uint16)]
        row = np.flatnonzero(drawn)
        return row, np.full(len(row), tree), drawn[row]


# ---- the forest while it grows -----------------------------------------------


@dataclasses.dataclass
class Growing:
    """Nodes of all trees in the order they were made, the roots first; the right child follows the left, -1 is none."""

    tree: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    stats: np.ndarray  # weight of each class

    @classmethod
    def roots(cls, trees: int, classes: int) -> Growing:
        none = np.full(trees, -1, np.int64)
        return cls(
            np.arange(trees), none, np.zeros(trees, np.int64), none.copy(), none.copy(), none.copy(),
            np.full(trees, -1.0), np.zeros((trees, classes)),
        )

    def add(self, tree: np.ndarray, parent: np.ndarray, level: np.ndarray, stats: np.ndarray) -> None:
        """New leaves."""
        none = np.full(len(tree), -1, np.int64)
        new = (tree, parent, level, none, none, none, np.full(len(tree), -1.0), stats)
        for field, more in zip(dataclasses.fields(self), new):
            setattr(self, field.name, np.concatenate([getattr(self, field.name), more]))

    def split(self, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Part the nodes; the left children's numbers."""
        left = len(self.tree) + 2 * np.arange(len(node))
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, left
        twice = np.repeat(node, 2)
        self.add(self.tree[twice], twice, self.level[twice] + 1, np.stack([near, far], axis=1).reshape(-1, near.shape[1]))
        return left

    def spans(self, node: np.ndarray, tried: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest code that rows of a node can have, for the features tried at it."""
        low, high = np.zeros_like(tried), codes[tried] - 1
        while len(node) and (self.parent[node] >= 0).any():
            above = self.parent[node]
            same = (above >= 0)[:, None] & (self.feature[above][:, None] == tried)
            went_left, cut = (self.left[above] == node)[:, None], self.cut[above][:, None]
            high = np.where(same & went_left, np.minimum(high, cut), high)
            low = np.where(same & ~went_left, np.maximum(low, cut + 1), low)
            node = np.where(above >= 0, above, node)
        return low, high


@dataclasses.dataclass
class Frontier:
    """What tasks need to bring rows to some nodes: the trees so far and the nodes' slots, in the order of their trees."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    slot: np.ndarray
    trees: list[tuple[int, int, int]]  # tree, first slot, slot behind the last
    seed: int
    bagged: bool

    @classmethod
    def of(cls, forest: Growing, nodes: np.ndarray, seed: int, bagged: bool) -> Frontier:
        slot = np.full(len(forest.tree), -1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        trees, first = np.unique(forest.tree[nodes], return_index=True)
        ranges = list(zip(trees.tolist(), first.tolist(), [*first[1:].tolist(), len(nodes)]))
        return cls(forest.feature, forest.cut, forest.left, slot, ranges, seed, bagged)

    def reached(self, block: Block, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a block that come to one of the nodes in a tree, the slots, and how often the tree draws each row."""
        row, at, drawn = block.rows_of(tree, self.seed, self.bagged)
        base, ended = row * block.width, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
        while len(at):
            left = self.left.take(at)
            moving = left >= 0
            if not moving.all():
                still = np.flatnonzero(~moving)
                slot = self.slot.take(at[still])
                still, slot = still[slot >= 0], slot[slot >= 0]
                ended.append((row[still], slot, drawn[still]))
                kept = np.flatnonzero(moving)
                row, base, at, left, drawn = row[kept], base[kept], at[kept], left[kept], drawn[kept]
            at = left + (block.codes.take(base + self.feature.take(at)) > self.cut.take(at))
        return tuple(np.concatenate(v) for v in zip(*ended))


def _standing(blocks: DataFrame, forest: Growing, nodes: np.ndarray, trees: int, seed: int, bagged: bool) -> DataFrame:
    """Blocks of the rows that come to any of the nodes, with their places, so that later passes start there."""
    nodes = nodes[np.argsort(forest.tree[nodes], kind="stable")]
    shared = blocks.sparkSession.sparkContext.broadcast((Frontier.of(forest, nodes, seed, bagged), nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, nodes = shared.value
        for block in Block.read(batches, trees):
            found = [f.reached(block, tree) for tree, _, _ in f.trees]
            many = np.zeros(trees, np.int32)
            many[[tree for tree, _, _ in f.trees]] = [len(row) for row, _, _ in found]
            row, slot, drawn = (np.concatenate(v) for v in zip(*found))
            if len(row):
                used, row = np.unique(row, return_inverse=True)
                codes = block.codes.reshape(-1, block.width)[used]
                parts = (np.cumsum(many).astype(np.int32), nodes[slot].astype(np.int32), row.astype(np.int16), drawn)
                standing = b"".join(v.tobytes() for v in parts)
                yield _block(block.number, codes.tobytes(), block.labels[used].astype(np.int16).tobytes(), standing)

    return written(blocks.mapInArrow(run, _BLOCKS), "standing")


# ---- levels ------------------------------------------------------------------

_AT_ONCE = 4_096  # rows whose bins are found at once: their numbers stay in a core's cache


def _counted(blocks: DataFrame, frontier: Frontier, tried: np.ndarray, low: np.ndarray, factor: np.ndarray, trees: int, classes: int) -> DataFrame:
    """(slot, counts): a task's counts of drawn rows by feature tried, bin and class."""
    shared = blocks.sparkSession.sparkContext.broadcast((frontier, tried, low.astype(np.int32), factor.astype(np.int32)))
    slots, places = tried.shape
    size = places * BINS * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, tried, low, factor = shared.value
        counts = np.zeros(slots * size, np.int32)
        of_place = np.arange(places) * (BINS * classes)
        for block in Block.read(batches, trees):
            for tree, first, behind in f.trees:
                rows, slot, drawn = f.reached(block, tree)
                for a in range(0, len(rows), _AT_ONCE):
                    row, s, w = (v[a : a + _AT_ONCE] for v in (rows, slot, drawn))
                    code = block.codes.take((row * block.width)[:, None] + tried.take(s, axis=0))
                    bin_ = ((code - low.take(s, axis=0)) * factor.take(s, axis=0)) >> 16
                    cell = bin_ * classes + ((s - first) * size + block.labels[row])[:, None] + of_place
                    here, w = counts[first * size : behind * size], np.repeat(w, places)
                    if len(here) <= 2 * cell.size:
                        here += np.bincount(cell.ravel(), w, len(here)).astype(np.int32)
                    else:
                        np.add.at(here, cell.ravel(), w.astype(np.int32))
        counts = counts.reshape(slots, size)
        seen = np.flatnonzero(counts.any(axis=1))
        for a in range(0, len(seen), 256):
            some = seen[a : a + 256]
            columns = [pa.array(some, pa.int32()), pa.array([counts[i].tobytes() for i in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "counts"])

    return blocks.mapInArrow(run, _COUNTS)


def _best(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of counts by (slot, place, bin, class): the place and bin of each slot's best cut, its gain, and the classes on both sides."""
    total = counts[:, 0].sum(axis=1)
    near = np.cumsum(counts, axis=2)[:, :, :-1]
    far = total[:, None, None] - near
    a, b, both = near * weights, far * weights, total * weights
    a_sum, b_sum, sums = a.sum(axis=-1), b.sum(axis=-1), both.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (a * a).sum(axis=-1) / a_sum + (b * b).sum(axis=-1) / b_sum
        gain = kept / sums[:, None, None] - ((both * both).sum(axis=-1) / sums**2)[:, None, None]
    gain = np.where((near.sum(axis=-1) > 0) & (far.sum(axis=-1) > 0), gain, -1.0).reshape(len(counts), -1)
    at, slots = gain.argmax(axis=1), np.arange(len(counts))
    place, first = at // (counts.shape[2] - 1), at % (counts.shape[2] - 1)
    # The cut lies in the middle of the bins without rows behind it.
    same = (near[slots, place] == near[slots, place, first][:, None]).all(axis=-1).sum(axis=1)
    return place, first + (same - 1) // 2, gain[slots, at], near[slots, place, first], far[slots, place, first]


def _best_cuts(counted: DataFrame, weights: np.ndarray, places: int, parts: int) -> pa.Table:
    """The best cut of every slot: its rows' counts meet in one task."""
    classes = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                some = np.frombuffer(value.as_buffer(), np.int32)
                if slot in found:
                    found[slot] += some
                else:
                    found[slot] = some.astype(np.int64)
        slots = sorted(found)
        at_once = max(1, 1_000_000 // (places * BINS * classes))
        for a in range(0, len(slots), at_once):
            some = slots[a : a + at_once]
            best = _best(np.stack([found[s] for s in some]).reshape(len(some), places, BINS, classes), weights)
            place, bin_, gain, near, far = best
            lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * classes), pa.array(v.ravel()))
            columns = [pa.array(some, pa.int32()), pa.array(place, pa.int32()), pa.array(bin_, pa.int32()), pa.array(gain), lists(near), lists(far)]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "place", "bin", "gain", "near", "far"])

    return counted.repartition(parts, "slot").mapInArrow(run, _CUTS).toArrow()


def _draw_features(rng: np.random.Generator, nodes: int, width: int, tried: int) -> np.ndarray:
    """For each node the features to try, any of them with the same chance."""
    step = max(1, 4_000_000 // width)
    parts = [rng.random((min(step, nodes - a), width)).argpartition(tried - 1, axis=1)[:, :tried] for a in range(0, nodes, step)]
    return np.concatenate(parts).astype(np.int64)


def _grow_level(blocks: DataFrame, forest: Growing, nodes: np.ndarray, codes: np.ndarray, weights: np.ndarray, seed: int, bagged: bool, rng) -> np.ndarray:
    """Part the nodes by their best cuts; the new children."""
    width, classes = len(codes), len(weights)
    places = math.ceil(math.sqrt(width))
    at_once = max(1, COUNT_BYTES // (4 * places * BINS * classes))
    cores, children = blocks.sparkSession.sparkContext.defaultParallelism, [np.zeros(0, np.int64)]
    nodes = nodes[np.argsort(forest.tree[nodes], kind="stable")]
    for a in range(0, len(nodes), at_once):
        some = nodes[a : a + at_once]
        tried = _draw_features(rng, len(some), width, places)
        low, high = forest.spans(some, tried, codes)
        factor = (BINS << 16) // (high - low + 1)
        frontier = Frontier.of(forest, some, seed, bagged)
        counted = _counted(blocks, frontier, tried, low, factor, int((forest.parent < 0).sum()), classes)
        got = _best_cuts(counted, weights, places, max(1, min(2 * cores, len(some)))).sort_by("slot")  # nodes have the same numbers however tasks end
        slot, place, bin_, gain = (got[n].to_numpy().astype(kind) for n, kind in zip(("slot", "place", "bin", "gain"), (int, int, int, float)))
        near, far = (_matrix(got[n].combine_chunks()).reshape(-1, classes) for n in ("near", "far"))
        forest.stats[some[slot]] = (near + far) * weights
        cut = np.flatnonzero(gain > LEAST_GAIN)
        slot, place = slot[cut], place[cut]
        code = low[slot, place] + (((bin_[cut] + 1) << 16) - 1) // factor[slot, place]
        left = forest.split(some[slot], tried[slot, place], code, gain[cut], near[cut] * weights, far[cut] * weights)
        children += [left, left + 1]
    return np.sort(np.concatenate(children))


# ---- nodes inside tasks ------------------------------------------------------


def _grow_nodes(blocks: DataFrame, forest: Growing, nodes: np.ndarray, depth: int, weights: np.ndarray, seed: int, bagged: bool) -> None:
    """Grow the nodes to the end, the rows of each in one task."""
    nodes = nodes[np.argsort(forest.tree[nodes], kind="stable")]
    sc, trees = blocks.sparkSession.sparkContext, int((forest.parent < 0).sum())
    shared = sc.broadcast((Frontier.of(forest, nodes, seed, bagged), nodes, (depth - forest.level[nodes]).astype(np.int32)))
    names = [c.split()[0] for c in _ROUTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, nodes, room = shared.value
        for block in Block.read(batches, trees):
            width, held, many = block.width, [], 0
            for tree, first, _ in f.trees:
                row, slot, drawn = f.reached(block, tree)
                held.append((np.full(len(row), tree), row, slot, drawn))
                many += len(row)
                if many and (many >= _AT_ONCE or first == f.trees[-1][1]):
                    tree_, row, slot, drawn = (np.concatenate(v) for v in zip(*held))
                    x = block.codes.reshape(-1, width)[row]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                    columns = [
                        pa.array(tree_, pa.int32()), pa.array(nodes[slot]), pa.array(row + (block.number << 15)), pa.array(block.labels[row], pa.int32()),
                        pa.array(drawn * weights[block.labels[row]]), lists, pa.array(room[slot]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    held, many = [], 0

    # Tasks of about equal size: more than cores, as nodes differ.
    grown = _grow(blocks.mapInArrow(run, _ROUTED), len(weights), seed, max(1, min(len(nodes), 8 * sc.defaultParallelism)))
    got = grown.select("node", "feature", "threshold", "left", "shares", "gain", "weight").toArrow()
    number = lambda n, fill, kind: got[n].combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False).astype(kind)
    node = number("node", 0, np.int64)
    # A node's root keeps its number g; the others are (g + 1) * 2^32 + 1, 2, ...
    inside = node >= 1 << 32
    root, place = np.where(inside, (node >> 32) - 1, node), np.where(inside, node & 0xFFFFFFFF, 0)
    order = np.lexsort((place, root))
    root, place = root[order], place[order]
    below = place > 0
    # New nodes are numbered one after another, those of a root together.
    before = len(forest.tree) + np.cumsum(below) - 1
    at = np.where(below, before, root)
    starts = np.flatnonzero(~below)
    base = np.repeat(before[starts], np.diff(np.append(starts, len(root))))
    left = number("left", -1, np.int64)[order]
    inner = left >= 0
    left = np.where(inner, base + (left & 0xFFFFFFFF), -1)
    stats = (_matrix(got["shares"].combine_chunks()).reshape(-1, len(weights)) * number("weight", 0, float)[:, None])[order]
    parent = np.full(len(forest.tree) + int(below.sum()), -1, np.int64)
    parent[left[inner]] = parent[left[inner] + 1] = at[inner]
    forest.add(forest.tree[root[below]], parent[at[below]], np.full(int(below.sum()), depth), stats[below])
    forest.stats[at], forest.left[at] = stats, left
    forest.feature[at] = number("feature", -1, np.int64)[order]
    forest.cut[at] = np.floor(number("threshold", -1.0, float)[order])
    forest.gain[at] = number("gain", -1.0, float)[order]


# ---- the whole ---------------------------------------------------------------


def grow_forest(data: DataFrame, forest: RandomForestClassifier, weights: dict[float, float] | None = None) -> RandomForestClassificationModel:
    """The estimator's forest on (features, label), its trees grown over coded rows.

    weights: of the rows of each class. Features are taken as numbers.
    """
    spark, seed = data.sparkSession, forest.getSeed() & (2**63 - 1)
    trees, depth = forest.getNumTrees(), forest.getMaxDepth()
    label = F.col("label")
    wrong = F.count_if(label.isNull() | F.isnan(label) | (label < 0) | (label != F.floor(label)) | (label > 999))
    count, largest, refused = data.agg(F.count("*"), F.max(label), wrong).first()
    if not count or refused or largest < 1:
        raise ValueError("labels must be whole numbers from 0 to 999, of two classes at least, in one row at least")
    by_class = np.array([(weights or {}).get(c, 1.0) for c in range(int(largest) + 1)])
    # Few tasks read all blocks, as each sends on its counts of every node.
    tasks, looked_at = 2 * spark.sparkContext.defaultParallelism, float(count) * trees
    with small_methods(spark):
        cuts = cut_points(data, count, seed)
        blocks = coded_rows(data, cuts).coalesce(tasks)
    codes = np.array([len(c) + 1 for c in cuts], np.int64)
    width, bagged = len(cuts), trees > 1
    grown, rng = Growing.roots(trees, len(by_class)), np.random.default_rng(seed)
    active, handed, handed_rows = np.arange(trees), np.zeros(0, np.int64), 0
    sizes = np.full(trees, float(count))
    leaf_rows = LEAF_BYTES // (8 * width + 32)
    most_handed = max(HANDED_BYTES, HANDED_TIMES * count * 2 * width) // (2 * width + 32)
    for _ in range(depth):
        small = sizes <= leaf_rows
        if handed_rows + sizes[small].sum() <= most_handed:
            handed, handed_rows = np.concatenate([handed, active[small]]), handed_rows + sizes[small].sum()
            active, sizes = active[~small], sizes[~small]
        if not len(active):
            break
        if (sizes.sum() + handed_rows) * FEWER <= looked_at:
            looked_at = sizes.sum() + handed_rows
            blocks = _standing(blocks, grown, np.concatenate([active, handed]), trees, seed, bagged).coalesce(tasks)
        children = _grow_level(blocks, grown, active, codes, by_class, seed, bagged, rng)
        children = children[(grown.stats[children] > 0).sum(axis=1) > 1]
        active, sizes = children, (grown.stats[children] / by_class).sum(axis=1)
    if len(handed):
        _grow_nodes(blocks, grown, handed, depth, by_class, seed, bagged)
    threshold = np.full(len(grown.tree), np.nan)
    for i, c in enumerate(cuts):
        here = np.flatnonzero(grown.feature == i)
        threshold[here] = c[grown.cut[here]]
    return _saved_model(spark, forest, grown, threshold, by_class, width)


def _pruned(forest: Growing) -> tuple[np.ndarray, np.ndarray]:
    """(left, kept): two leaves that predict the same class become one, as in MLlib; a node without left is a leaf."""
    left, says = forest.left.copy(), forest.stats.argmax(axis=1)
    while True:
        inner = np.flatnonzero(left >= 0)
        a = left[inner]
        alike = (left[a] < 0) & (left[a + 1] < 0) & (says[a] == says[a + 1])
        if not alike.any():
            break
        says[inner[alike]] = says[a[alike]]
        left[inner[alike]] = -1
    kept, level = np.zeros(len(left), bool), np.flatnonzero(forest.parent < 0)
    while len(level):
        kept[level] = True
        below = left[level]
        level = np.concatenate([below[below >= 0], below[below >= 0] + 1])
    return left, kept


def _saved_model(spark: SparkSession, estimator: RandomForestClassifier, forest: Growing, threshold: np.ndarray, weights: np.ndarray, width: int) -> RandomForestClassificationModel:
    """MLlib's own model of the forest: written in the form that MLlib saves models in, and loaded."""
    left, kept = _pruned(forest)
    # Tree by tree; a child comes behind its parent.
    order = np.flatnonzero(kept)
    order = order[np.argsort(forest.tree[order], kind="stable")]
    tree, trees = forest.tree[order], int(forest.tree.max()) + 1
    first = np.searchsorted(tree, np.arange(trees))
    number = np.full(len(left), -1, np.int64)
    number[order] = np.arange(len(order)) - first[tree]
    inner = left[order] >= 0
    child = lambda by: np.where(inner, number[np.where(inner, left[order] + by, 0)], -1)
    stats = forest.stats[order]
    total = stats.sum(axis=1)
    impurity = np.where(total > 0, 1 - (stats**2).sum(axis=1) / np.where(total > 0, total, 1) ** 2, 0.0)
    rows = np.rint(stats / weights).sum(axis=1).astype(np.int64)
    columns = {
        "id": number[order], "prediction": stats.argmax(axis=1).astype(float), "impurity": impurity, "rawCount": rows,
        "gain": np.where(inner, forest.gain[order], -1.0), "leftChild": child(0), "rightChild": child(1),
        "featureIndex": np.where(inner, forest.feature[order], -1),
    }
    path = fresh_path(spark, "grown-forest")
    for a in range(0, len(order), NODES_AT_ONCE):
        here = slice(a, a + NODES_AT_ONCE)
        flat = {n: pa.array(v[here]) for n, v in columns.items()}
        lists = lambda v, many: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(v))
        flat["cut"] = lists(threshold[order][here][inner[here]], inner[here])
        flat["impurityStats"] = lists(stats[here].ravel(), np.full(len(stats[here]), len(weights)))
        nodes = spark.createDataFrame(pa.table({"treeID": pa.array(tree[here]), **flat}))
        split = F.struct(F.col("featureIndex").cast("int").alias("featureIndex"), F.col("cut").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
        int_ = lambda c: F.col(c).cast("int").alias(c)
        data = F.struct(int_("id"), "prediction", "impurity", "impurityStats", "rawCount", "gain", int_("leftChild"), int_("rightChild"), split.alias("split"))
        nodes.select(int_("treeID"), data.alias("nodeData")).write.mode("append").parquet(os.path.join(path, "data"))
    about = lambda kind, name, leave=(): {
        "class": f"org.apache.spark.ml.classification.{kind}ClassificationModel", "timestamp": int(time.time() * 1000),
        "sparkVersion": spark.version, "uid": name,
        "paramMap": {p.name: v for p, v in estimator._paramMap.items() if p.name not in leave},
        "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items() if p.name not in leave},
    }
    of_forest = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")
    each = [(t, json.dumps(about("DecisionTree", f"{estimator.uid}_{t}", of_forest)), 1.0) for t in range(trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(os.path.join(path, "treesMetadata"))
    whole = about("RandomForest", estimator.uid) | {"numFeatures": width, "numClasses": len(weights), "numTrees": trees}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(os.path.join(path, "metadata"))
    return RandomForestClassificationModel.load(path)
