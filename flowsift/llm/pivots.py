"""Near-duplicate vectors by a pivot-permutation index.

Reference points are drawn from the vectors, no two of them close to each other, so that
a dense region has few and its vectors name the same ones. A vector is described by its
nearest reference points in order; inverted lists hold, for each reference point, the
vectors that name it. Vectors of a list that share enough reference points are verified
by their cosine in double precision. A pair is counted in the list of its smallest shared
point only. Long lists are cut into blocks, and every pair of blocks is a unit.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import store
from flowsift.llm.linking import LINKS, block_count, block_of, local_groups, resolve


@dataclass(frozen=True)
class Index:
    """cosine: least cosine of a link. nearest: reference points that describe a vector.

    shared: reference points that a candidate pair has in common. pivots_per_root: reference
    points are this times the square root of the number of vectors, so that lists and
    reference points grow alike. apart: reference points have a cosine below this, for which
    draws times as many candidates are looked at. sample: most vectors that the index is
    fitted on. block: vectors on one side of a comparison unit, on average.
    """

    cosine: float = 0.95
    nearest: int = 10
    shared: int = 2
    pivots_per_root: float = 1.5
    least_pivots: int = 32
    apart: float = 0.8
    draws: int = 4
    sample: int = 65_536
    block: int = 1024


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one; lengths may differ between rows."""
    flat, sizes = column.flatten(), np.diff(column.offsets.to_numpy())
    if len(column) and not column.null_count and not flat.null_count and (sizes == sizes[0]).all():
        x = flat.to_numpy(zero_copy_only=False).reshape(len(column), sizes[0]).copy()
        good = np.isfinite(x).all(axis=1)
        x[~good] = 0
    else:
        rows = column.to_pylist()
        width = max((len(r) for r in rows if r is not None), default=0)
        x, good = np.zeros((len(rows), width)), np.zeros(len(rows), bool)
        for i, r in enumerate(rows):
            if r and None not in r:
                x[i, : len(r)] = r
                good[i] = np.isfinite(x[i]).all()
                x[i] = x[i] if good[i] else 0
    largest = np.abs(x).max(axis=1, initial=0)
    good &= largest > 0
    x[good] /= largest[good, None]
    x[good] /= np.linalg.norm(x[good], axis=1)[:, None]
    return x, good


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, dim, unit): unit vectors as bytes; key and unit are null where nothing can be linked."""

    def run(batches):
        for batch in batches:
            x, good = _unit(batch.column(1))
            sizes = [int(n) for n in np.diff(batch.column(1).offsets.to_numpy())]
            units = [x[i, : sizes[i]].tobytes() if good[i] else None for i in range(len(good))]
            keys = [None if u is None else hashlib.md5(u).hexdigest() for u in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(units, pa.binary())],
                names=["vec_id", "key", "dim", "unit"],
            )

    picked = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    return picked.mapInArrow(run, "vec_id long, key string, dim int, unit binary")


def thinned(candidates: np.ndarray, apart: float, wanted: int) -> np.ndarray:
    """The first `wanted` candidates whose cosine with every one kept before is below `apart`."""
    kept = candidates[:0]
    for low in range(0, len(candidates), 256):
        part = candidates[low : low + 256]
        part = part[(part @ kept.T).max(axis=1, initial=-1) < apart]
        close, own = part @ part.T >= apart, []
        for i in range(len(part)):
            if not close[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, part[own]])[:wanted]
        if len(kept) == wanted:
            break
    return kept


def fit_pivots(classes: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """Reference points of each length of vector: the first distinct vectors in hash order that lie apart.

    Their number follows the square root of the vectors, or is lower where fewer lie apart;
    at most `sample` vectors are looked at.
    """
    out = {}
    for dim, n in sorted(classes.groupBy("dim").count().collect()):
        wanted = min(index.sample, max(index.least_pivots, math.ceil(index.pivots_per_root * math.sqrt(n))))
        drawn = min(index.sample, index.draws * wanted)
        rows = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(drawn).select("unit").collect()
        out[dim] = thinned(np.frombuffer(b"".join(bytes(r.unit) for r in rows)).reshape(len(rows), dim), index.apart, wanted)
    return out


def describe(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest reference points of each vector, nearest first."""
    k = min(nearest, len(pivots))
    closeness = x @ pivots.T
    part = np.argpartition(-closeness, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(closeness, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def entered(points: np.ndarray, n_pivots: int, shared: int) -> list[np.ndarray]:
    """The lists that each vector enters: those of its points that can be the smallest shared one of a pair.

    A pair shares `shared` points, so the last of a vector's points are never the smallest;
    and two choices of k out of m points share one among the first 2 (m - k) + 1.
    """
    k = points.shape[1]
    first = np.sort(points, axis=1)[:, : k - min(shared, k) + 1].astype(np.int32)
    return [row[row <= 2 * (n_pivots - k)] for row in first]


def _described(classes: DataFrame, pivots: dict[int, np.ndarray], index: Index) -> DataFrame:
    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            units = batch.column(3).to_pylist()
            lists: list = [None] * len(dims)
            own: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(units[i] for i in at)).reshape(len(at), dim)
                points = describe(x, pivots[int(dim)], index.nearest)
                for i, row, named in zip(at, points, entered(points, len(pivots[int(dim)]), index.shared), strict=True):
                    lists[i], own[i] = row.astype(np.int32), named
            whole = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, whole), pa.array(own, whole)],
                names=["key", "members", "dim", "unit", "points", "lists"],
            )

    return classes.select("key", "members", "dim", "unit").mapInArrow(
        run, "key string, members long, dim int, unit binary, points array<int>, lists array<int>"
    )


def linked_in_list(x: np.ndarray, points: np.ndarray, point: int, index: Index) -> np.ndarray:
    """Which pairs this list links: enough shared points, none smaller than this one, cosine high enough."""
    names, codes = np.unique(points, return_inverse=True)
    member = np.zeros((len(points), len(names)), np.float32)
    member[np.repeat(np.arange(len(points)), points.shape[1]), codes.ravel()] = 1
    shared = member @ member.T
    earlier = member[:, names < point]
    linked = (shared >= min(index.shared, points.shape[1])) & (earlier @ earlier.T == 0)
    linked &= x @ x.T >= index.cosine
    np.fill_diagonal(linked, False)
    return linked


def _compare(index: Index):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("sub", sort=False):
            part = part.sort_values("key")
            if len(part) < 2:
                continue
            dim = int(part["dim"].iloc[0])
            x = np.frombuffer(b"".join(part["unit"])).reshape(len(part), dim)
            linked = linked_in_list(x, np.stack(list(part["points"])), int(part["point"].iloc[0]), index)
            if part["crosses"].iloc[0]:
                side = part["side"].to_numpy()
                linked &= side[:, None] != side[None, :]
            hit = linked.any(axis=1)
            names, label = part["key"].to_numpy(), local_groups(linked)
            count = linked @ part["members"].to_numpy(np.int64)
            out.append(pd.DataFrame({"key": names[hit], "links": count[hit], "root": names[label[hit]]}))
        empty = pd.DataFrame({"key": pd.Series(dtype=object), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype=object)})
        return pd.concat(out) if out else empty

    return run


def near_vectors(vectors: DataFrame, id_col: str, vector_col: str, index: Index = Index()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, key.

    Null and zero vectors and those with null or non-finite components link with nothing,
    nor do vectors of different lengths. Vectors of equal direction are one class and
    are all linked. Repeated rows are vectors of their own; rows with the component's id
    are all kept. Null ids are counted but never name a component that has another id.
    Other columns play no part; no vectors give no rows.
    """
    prepared, _ = store(_prepared(vectors, id_col, vector_col), "unit-vectors")
    classes = prepared.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.count("*").alias("members"), F.min("vec_id").alias("first_id"), F.first("dim").alias("dim"), F.first("unit").alias("unit")
    )
    classes, _ = store(classes, "vector-classes")
    described, _ = store(_described(classes, fit_pivots(classes, index), index), "described")
    entries = described.withColumn("point", F.explode("lists")).drop("lists")
    sizes = entries.groupBy("dim", "point").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("dim", "point", block_count(F.col("n"), index.block).alias("nb"))
    placed = entries.join(sizes, ["dim", "point"]).withColumn("at", block_of(F.col("key"), F.col("nb")))
    other = F.sequence(F.lit(0), F.col("nb") - 1)
    units = placed.withColumn("x", F.explode(other)).select(
        "key", "members", "dim", "unit", "points", "point",
        F.concat_ws("/", "dim", "point", F.least("at", "x"), F.greatest("at", "x")).alias("sub"),
        (F.col("at") > F.col("x")).cast("int").alias("side"), (F.col("at") != F.col("x")).alias("crosses"),
    )
    links, _ = store(units.groupBy("sub").applyInPandas(_compare(index), LINKS), "links")
    slim = classes.select("key", "members", "first_id", F.lit(True).alias("linkable"))
    return resolve(prepared.select("vec_id", "key"), slim, links, "vec_id")
