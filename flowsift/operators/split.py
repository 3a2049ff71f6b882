"""Exact random splits.

Rows are ordered by md5(seed:id). The k-th smallest (hash, id) pair is found by
counting hash prefixes, so the labelling itself is a comparison with two literals:
no row is shuffled, and the result does not depend on partitioning.
"""

from __future__ import annotations

import math
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.operators.position import ordered_position
from flowsift.schema import TESTING, TRAINING
from flowsift.session import written

PREFIX_STEP = 4  # hex digits added per counting pass: at most 65,536 groups per class
SMALL = 100_000
BROADCAST_CLASSES = 500_000  # some 100 bytes each


class Cut(NamedTuple):
    digest: str
    id: Any


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def cut_point(df: DataFrame, id_col: str, seed: int, k: int) -> Cut | None:
    """The last (hash, id) pair among the k smallest ones; None for k = 0."""
    if k <= 0:
        return None
    rest, digits = df.select(shuffle_key(id_col, seed).alias("h"), F.col(id_col).alias("i")), PREFIX_STEP
    while True:
        prefix = F.substring("h", 1, digits)
        # One row per prefix in use, at most 16 ** PREFIX_STEP inside the one before.
        counts = rest.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"))
        cut = (
            counts.withColumn("upto", F.sum("n").over(Window.orderBy("p")))
            .where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
            .first()
        )
        if cut is None:
            raise ValueError("fewer rows than asked for")
        rest, k = rest.where(prefix == F.lit(cut["p"])), k - (cut["upto"] - cut["n"])
        if cut["n"] <= SMALL or digits >= 32:
            break
        digits += PREFIX_STEP
    last = rest.orderBy("h", "i").limit(k).orderBy(F.desc("h"), F.desc("i")).first()
    return Cut(last["h"], last["i"])


def _chosen(id_col: str, seed: int, cut: Cut) -> Column:
    h = shuffle_key(id_col, seed)
    return (h < cut.digest) | ((h == cut.digest) & (F.col(id_col) <= F.lit(cut.id)))


def assign_split(df: DataFrame, frac: float = 0.3, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly floor(frac * n) rows get T = 'training', the others 'testing'."""
    k = int(df.count() * frac)
    cut = cut_point(df, id_col, seed, k)
    chosen = _chosen(id_col, seed, cut) if cut else F.lit(False)
    return df.withColumn("T", F.when(chosen, TRAINING).otherwise(TESTING))


def split_summary(df: DataFrame) -> DataFrame:
    """Counts of a finished split and their percentages, zeros for an empty log."""
    total = F.count("*")
    counts = {"training": F.count_if(F.col("T") == TRAINING), "testing": F.count_if(F.col("T") == TESTING)}
    return df.agg(
        total.alias("total_rows"),
        *[n.alias(f"{name}_rows") for name, n in counts.items()],
        *[
            F.round(F.coalesce(F.try_divide(n, total) * 100, F.lit(0.0)), 2).alias(f"{name}_percentage")
            for name, n in counts.items()
        ],
    )


def allocate(counts: DataFrame, test_size: float) -> DataFrame:
    """counts: (_g, _c) per class. (_g, _k): test rows of each, ceil(test_size * n) in all, training shares by largest remainder.

    Equal remainders go to the smaller class. Classes are ordered by all tasks, whatever their number.
    """
    n = counts.agg(F.sum("_c")).first()[0]
    n_train = n - math.ceil(test_size * n)
    share = F.lit(n_train).cast("decimal(38,0)") * F.col("_c")  # whole numbers: no remainder is rounded
    rest = F.pmod(share, F.lit(n).cast("decimal(38,0)"))
    base = ((share - rest) / F.lit(n)).cast("long")
    parted = counts.select("_g", "_c", base.alias("_train"), (-rest).alias("_falling"))
    more = n_train - parted.agg(F.sum("_train")).first()[0]
    ranked = ordered_position(parted, ["_falling", "_g"], 1, "_rank")
    return ranked.select("_g", (F.col("_c") - F.col("_train") - (F.col("_rank") <= more).cast("int")).alias("_k"))


def _with_class(df: DataFrame, table: DataFrame, on: list[str], classes: int, how: str = "inner") -> DataFrame:
    """Join rows with one row per class; up to BROADCAST_CLASSES of them are broadcast, more are joined by class."""
    return df.join(F.broadcast(table) if classes <= BROADCAST_CLASSES else table, on, how)


def cut_table(df: DataFrame, label: str, id_col: str, seed: int, wanted: DataFrame, classes: int) -> DataFrame:
    """(_g, _h, _i): for every class of `wanted` (_g, _k) the last (hash, id) pair among its _k smallest ones.

    Hash prefixes are counted per class; each pass keeps only the rows in the prefix that a class's
    cut falls into. Plans and driver hold nothing per class.
    """
    hashed = df.select(F.col(label).alias("_g"), shuffle_key(id_col, seed).alias("_h"), F.col(id_col).alias("_i"))
    rest, digits = _with_class(hashed, wanted.where("_k > 0"), ["_g"], classes), PREFIX_STEP
    upto = Window.partitionBy("_g").orderBy("_p")
    while True:
        counts = rest.groupBy("_g", "_k", F.substring("_h", 1, digits).alias("_p")).agg(F.count("*").alias("_n"))
        summed = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n"))
        crossed = summed.where((F.col("_upto") >= F.col("_k")) & (F.col("_before") < F.col("_k")))
        cuts = written(crossed.select("_g", "_p", (F.col("_k") - F.col("_before")).alias("_left"), "_n"), "class-cuts")
        inside = rest.drop("_k").withColumn("_p", F.substring("_h", 1, digits))
        rest = _with_class(inside, cuts.select("_g", "_p", F.col("_left").alias("_k")), ["_g", "_p"], classes).drop("_p")
        if (cuts.agg(F.max("_n")).first()[0] or 0) <= SMALL or digits >= 32:
            break
        digits += PREFIX_STEP
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_i"))
    return written(rest.withColumn("_r", rank).where(F.col("_r") == F.col("_k")).select("_g", "_h", "_i"), "class-cuts")


def stratified_split(
    df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42, id_col: str = "id"
) -> DataFrame:
    """Add `split` ('train' / 'test') with class shares kept, for any number of classes.

    A null label is an error: such a row belongs to no class.
    """
    counts = written(df.groupBy(F.col(label).alias("_g")).agg(F.count("*").alias("_c")), "classes")
    classes, empty = counts.agg(F.count("*"), F.sum(F.when(F.col("_g").isNull(), F.col("_c")))).first()
    if empty:
        raise ValueError(f"{empty} rows have no {label}")
    if not classes:
        return df.withColumn("split", F.lit("train"))
    cuts = cut_table(df, label, id_col, seed, allocate(counts, test_size), classes)
    keyed = df.withColumn("_g", F.col(label))
    joined = _with_class(keyed, cuts, ["_g"], classes, "left")
    h = shuffle_key(id_col, seed)
    in_test = (h < F.col("_h")) | ((h == F.col("_h")) & (F.col(id_col) <= F.col("_i")))
    return joined.withColumn("split", F.when(in_test, "test").otherwise("train")).select(*df.columns, "split")
