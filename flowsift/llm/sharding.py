"""Shards of near-equal bytes by sampled splitters.

Keys are drawn with a chance that follows the record's size, the quantiles of the draw
become range boundaries, and the exact bytes of each range are counted. A range that is
too heavy is drawn from again and cut further. Rows then move once, to their range; a
prefix sum inside each range and over the ranges gives every row its global position,
and the shard follows from it. The result depends on the order of the keys only, not on
the draw.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.llm.common import fresh_name, store

#: Ranges for each shard before subdividing, and draws for each range.
RANGES_PER_SHARD = 16
DRAWS_PER_RANGE = 8
#: A group of equal keys stays whole up to this part of a shard.
WHOLE_GROUP = 1 / 16


#: Composite keys: NUL in a text becomes NUL 1, NUL NUL ends it, NUL 2 parts keys in a list.
_ESCAPED, _ENDED, _NEXT = "\0\1", "\0\0", "\0\2"


def _position_key(key: Column, tie: Column, uid: Column) -> Column:
    """One text that orders rows by key, tie and row number."""
    shifted = (tie.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    return F.concat(
        F.replace(key, F.lit("\0"), F.lit(_ESCAPED)), F.lit(_ENDED), F.lpad(shifted, 20, "0"), F.lpad(uid.cast("string"), 20, "0")
    )


def _draws(size: str, step: float, seed: int) -> Column:
    """How often a row is drawn: size/step times on average, never by chance of the task."""
    wanted = F.col(size) / F.lit(float(step))
    chance = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(wanted) + (chance < wanted - F.floor(wanted)).cast("long")).cast("long")


def _quantiles(sample: list[tuple[str, int]], ranges: int) -> list[str]:
    """Up to ranges - 1 distinct keys at boundaries of equal drawn weight, in order."""
    total, seen, found = sum(n for _, n in sample), 0, []
    for key, n in sorted(sample):
        at, seen = seen, seen + n
        if at * ranges // total < seen * ranges // total:
            found.append(key)
    return sorted(set(found))


def _range_number(splitters: list[str]) -> Column:
    """How many boundaries lie at or below the row's key, by a search in two steps."""
    if not splitters:
        return F.lit(0)
    width = max(1, math.isqrt(len(splitters)))
    constant = lambda keys: F.split(F.lit(_NEXT.join(keys)), _NEXT)  # noqa: E731  folded into one literal
    below = lambda array: F.size(F.filter(array, lambda s: s <= F.col("at")))
    block = below(constant(splitters[::width]))
    inside = below(F.slice(constant(splitters), (block - 1) * width + 1, F.lit(width)))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + inside).cast("int")


def assign_shards(
    records: DataFrame, key: Column, tie: Column, size: Column, shards: int, seed: int = 17
) -> DataFrame:
    """`records` with `shard` (0 to shards - 1), `slot` (gapless from 0 in the shard) and `shard_bytes_before`.

    key: text by which records are ordered and grouped; tie: whole number that orders
    equal keys; size: bytes, at least 1. Equal keys share a shard unless together they
    are heavier than WHOLE_GROUP of a shard, then they are cut by row. Shards differ by
    at most half such a group and one record on either side. Null keys and ties count as
    the empty text and the smallest number. Repeated rows are rows of their own. No rows
    give no rows. Input columns named like the three results are replaced.
    """
    spark = records.sparkSession
    own = [c for c in records.columns if c.lower() not in ("shard", "slot", "shard_bytes_before")]
    names = {c: f"c{i}" for i, c in enumerate(own)}
    base = records.select(
        *[F.col(f"`{c}`").alias(names[c]) for c in own],
        F.coalesce(key, F.lit("")).alias("k"),
        F.coalesce(tie.cast("long"), F.lit(-(1 << 63))).alias("t"),
        F.greatest(size.cast("long"), F.lit(1)).alias("size"),
    ).withColumn("uid", F.monotonically_increasing_id())
    base = base.withColumn("at", _position_key(F.col("k"), F.col("t"), F.col("uid"))).drop("t")
    base, _ = store(base, "shard-rows")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * RANGES_PER_SHARD
    target = max(1.0, total / ranges)
    splitters = _split(base, target, seed) if total else []
    by_range = base.withColumn("rng", _range_number(splitters))

    sizes = sorted(by_range.groupBy("rng").agg(F.sum("size"), F.count("*")).collect())
    before, at = [0] * (len(splitters) + 1), 0
    for rng, weight, _ in sizes:
        before[rng] = at
        at += weight
    in_order = Window.partitionBy("rng").orderBy("at")
    group = Window.partitionBy("rng", "k")
    offset = F.element_at(F.lit(before).cast("array<long>"), F.col("rng") + 1)
    placed = (
        by_range.withColumn("start", offset + F.sum("size").over(in_order) - F.col("size"))
        .withColumn("group_start", F.min("start").over(group))
        .withColumn("group_end", F.max(F.col("start") + F.col("size")).over(group))
        .withColumn("seq", F.row_number().over(in_order) - 1)
    )
    whole = F.col("group_end") - F.col("group_start") <= F.lit(WHOLE_GROUP * total / shards)
    middle = F.when(whole, F.col("group_start") + F.col("group_end")).otherwise(2 * F.col("start") + F.col("size"))
    # Integers throughout: floor(shards * middle / (2 * total)).
    number = F.expr("least({0}, CAST((CAST({0} + 1 AS DECIMAL(20,0)) * m) DIV {1} AS INT))".format(shards - 1, 2 * max(total, 1)))
    placed, _ = store(placed.withColumn("m", middle).withColumn("shard", number).drop("m"), "shard-places")

    # Each range's rows of a shard follow each other; where they begin in the shard is a sum of counts.
    counts = placed.groupBy("shard", "rng").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min("start").alias("b"))
    begins, shard_bytes, filled = {}, {}, defaultdict(int)
    for shard, rng, n, first, byte in sorted(counts.collect()):
        begins[shard, rng] = filled[shard] - first
        shard_bytes[shard] = min(byte, shard_bytes.get(shard, byte))
        filled[shard] += n
    table = [(shard, rng, begin, shard_bytes[shard]) for (shard, rng), begin in begins.items()]
    # At most one row for each range and shard that meet: ranges + shards rows.
    begin = spark.createDataFrame(table, "shard int, rng int, begin long, opening long")
    return placed.join(F.broadcast(begin), ["shard", "rng"]).select(
        *[F.col(names[c]).alias(c) for c in own],
        "shard",
        (F.col("seq") + F.col("begin")).alias("slot"),
        (F.col("start") - F.col("opening")).alias("shard_bytes_before"),
    )


def _split(base: DataFrame, target: float, seed: int) -> list[str]:
    """Boundaries such that no range of several rows is heavier than four targets.

    The first draw gives quantiles of the whole; overfull ranges are drawn from again.
    Equal keys stay in one range unless they alone are too heavy; a record that is too
    heavy is a range of its own. A draw holds about DRAWS_PER_RANGE keys for each range,
    whatever the number of rows. Splitting ends when a draw finds no new boundary.
    """
    splitters: list[str] = []
    heavy: list[int] | None = None
    for turn in itertools.count():
        drawn = base
        if heavy is not None:
            drawn = base.withColumn("rng", _range_number(splitters)).where(F.col("rng").isin(heavy))
        sample = drawn.withColumn("n", _draws("size", target / DRAWS_PER_RANGE, seed + turn)).where("n > 0")
        found: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for at, n in sample.select("at", "n").collect():
            found[bisect.bisect_right(splitters, at)].append((at, n))
        new: set[str] = set()
        for part in found.values():
            weight = Counter()
            for at, n in part:
                weight[at[: at.rindex(_ENDED)]] += n
                if n > 2 * DRAWS_PER_RANGE:
                    new |= {at, at + "\0"}
            for at in _quantiles(part, max(2, round(sum(n for _, n in part) / DRAWS_PER_RANGE))):
                group = at[: at.rindex(_ENDED)]
                new.add(at if weight[group] > 2 * DRAWS_PER_RANGE else group + _ENDED)
        if new <= set(splitters):
            break
        splitters = sorted(new | set(splitters))
        sizes = base.groupBy(_range_number(splitters).alias("rng")).agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        heavy = [r.rng for r in sizes.where((F.col("w") > 4 * target) & (F.col("n") > 1)).collect()]
        if not heavy:
            break
    return splitters


def write_shards(sharded: DataFrame, path: str) -> None:
    """The records as one folder per shard, ordered by slot inside each file."""
    salt = fresh_name(sharded.columns, "part")
    parts = sharded.withColumn(salt, F.floor(F.col("slot") / 1_000_000))
    parts.repartition("shard", salt).sortWithinPartitions("shard", "slot").drop(salt).write.partitionBy("shard").parquet(path)
