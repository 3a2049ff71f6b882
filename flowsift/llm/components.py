"""Connected components by alternating star contraction.

Every round joins edges to per-node minima, both pre-aggregated by Spark before the
shuffle, and writes the new edges to the shared folder. Nothing is collected but a
count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import discard, store


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    `edges` has the two columns u and v of one orderable type. Loops and nulls are left
    out, repeated edges count once, and no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = store(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        middle, middle_path = store(large.distinct(), "edges")
        least = _minima(middle)
        small = middle.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, after_path = store(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(spark, path)
        discard(spark, middle_path)
        now, path, before, state = after, after_path, state, _state(after)
        if state == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
