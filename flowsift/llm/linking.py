"""What the two pair operators share: units of comparison, and links to one row per record.

Records are first reduced to classes of equal content (`key`, `members`, `first_id`).
A unit is a set of classes that one task compares; it returns, per class, the number of
linked members and the smallest key of the class's local group. Pairs never become rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.components import connected_components

#: What a unit of comparison returns.
LINKS = "key string, links long, root string"


def local_groups(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index reachable from each row."""
    n = len(linked)
    label = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def block_count(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(size)))).cast("int")


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def resolve(records: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """One row per record: id_col, n_links, component_id, kept, key.

    records: (id_col, key); classes: (key, members, first_id, linkable); links: LINKS rows.
    Members of one linkable class are linked with each other. component_id is the
    smallest id of the component; a record that cannot be linked is its own.
    """
    found = links.groupBy("key").agg(F.sum("links").alias("links"))
    edges = links.where("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v"))
    component = connected_components(edges)
    own = classes.where("linkable").join(component, F.col("key") == F.col("node"), "left").drop("node")
    own = own.join(found, "key", "left").select(
        "key",
        "first_id",
        (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        F.coalesce("component", "key").alias("component"),
    )
    smallest = own.groupBy("component").agg(F.min("first_id").alias("smallest"))
    per_class = own.join(smallest, "component").select("key", "n_links", "smallest", (F.col("component")).alias("group"))
    out = records.join(per_class, "key", "left")
    of = F.when(F.col("n_links").isNull(), F.col(id_col)).otherwise(F.col("smallest"))
    return out.select(
        id_col,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        of.alias("component_id"),
        F.col(id_col).eqNullSafe(of).alias("kept"),
        "key",
    )
