"""Features without a column per key: dictionaries of any size and sparse vectors.

A dictionary is a table (key, slot, n): it is numbered, joined and stored by all tasks and
never comes to the driver. A small one is broadcast, by its measured bytes; of a large one
only the few keys that hold many rows are, and the rest is joined by key.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from flowsift.functions import parse_number
from flowsift.operators.position import ordered_position
from flowsift.schema import RECORD_NOT_FEATURES
from flowsift.session import fresh_path, written

#: Bytes of a dictionary that is broadcast whole, and the share of all rows from which a key counts as hot.
BROADCAST_BYTES = 64_000_000
HOT_SHARE = 1 / 1000


def number_keys(keys: DataFrame, *order: str) -> DataFrame:
    """(key, slot, n) from distinct keys with their row counts, slots from 0 in the given order; written down."""
    return written(ordered_position(keys, list(order), 0, "slot").select("key", F.col("slot").cast("int"), "n"), "keys")


def look_up(df: DataFrame, key: Column, keys: DataFrame, name: str = "slot", broadcast_bytes: int | None = None) -> DataFrame:
    """`df` with the slot of `key`, null for a key that the dictionary does not have."""
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    keyed = df.withColumn("_key", key)
    slots = keys.select(F.col("key").alias("_key"), F.col("slot").alias(name))
    size, rows = keys.agg(F.sum(F.octet_length("key") + 24), F.sum("n")).first()
    if (size or 0) <= limit:
        return keyed.join(F.broadcast(slots), "_key", "left").drop("_key")
    many = F.col("n") > F.lit(rows * HOT_SHARE)  # at most 1 / HOT_SHARE keys
    hot = keys.where(many).select(F.col("key").alias("_key"), F.col("slot").alias("_hot"))
    first = keyed.join(F.broadcast(hot), "_key", "left")
    found = first.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", name)
    others = first.where(F.col("_hot").isNull()).drop("_hot")
    rare = others.join(keys.where(~many).select(F.col("key").alias("_key"), F.col("slot").alias(name)), "_key", "left")
    return found.unionByName(rare).drop("_key")


def sparse_vector(size: Column, slots: Column, values: Column) -> Column:
    """A sparse vector in its stored form; slots rise."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"),
        slots.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"),
    )


def as_vectors(df: DataFrame, col: str = "features") -> DataFrame:
    """`df`, written down, with its stored-form column read as a vector column."""
    path = fresh_path(df.sparkSession, "vectors")
    df.write.parquet(path)
    fields = [StructField(f.name, VectorUDT() if f.name == col else f.dataType) for f in df.schema]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


# ---- records ------------------------------------------------------------------


def record_dictionary(m: DataFrame, order_col: str = "id") -> DataFrame:
    """(key, slot, n) of a decoded log's feature keys, in order of first appearance; no 'label' anywhere is an error."""
    keys = m.select(order_col, F.posexplode_outer(F.map_keys("data")).alias("pos", "key")).where(F.col("key").isNotNull())
    seen = written(keys.groupBy("key").agg(F.min(F.struct(order_col, "pos")).alias("seen"), F.count("*").alias("n")), "seen-keys")
    if seen.where(F.col("key") == "label").isEmpty():
        raise ValueError("no record has a 'label' key")
    return number_keys(seen.where(~F.col("key").isin(*RECORD_NOT_FEATURES)), "seen")


def record_slots(m: DataFrame, keys: DataFrame, id_col: str = "id", broadcast_bytes: int | None = None) -> DataFrame:
    """(id, label, features in stored form): numbers by slot; what is missing, no number or 0 takes no room. Ids are unique.

    Keys that the dictionary does not have play no part. A record must fit a row.
    """
    label = parse_number(F.try_element_at(F.col("data"), F.lit("label"))).cast("int").alias("label")
    entries = m.select(id_col, label, F.explode_outer(F.map_entries("data")).alias("e"))
    number = parse_number(F.col("e.value"))
    numbers = entries.select(id_col, "label", F.col("e.key").alias("key"), F.when(number != 0, number).alias("value"))
    found = look_up(numbers, F.when(F.col("value").isNotNull(), F.col("key")), keys, broadcast_bytes=broadcast_bytes)
    one = F.when(F.col("slot").isNotNull(), F.struct("slot", "value"))
    rows = found.groupBy(id_col, "label").agg(F.array_sort(F.collect_list(one)).alias("e"))
    size = keys.agg(F.count("*")).first()[0]
    return rows.select(id_col, "label", sparse_vector(F.lit(size), F.col("e.slot"), F.col("e.value")).alias("features"))


def record_vectors(m: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """`record_slots` with a vector column."""
    return as_vectors(record_slots(m, keys, id_col))


class SparseForest:
    """A fitted forest behind a dictionary of record keys."""

    def __init__(self, keys: DataFrame, forest: RandomForestClassificationModel, id_col: str = "id"):
        self.keys, self.forest, self.id_col = keys, forest, id_col

    def transform(self, m: DataFrame) -> DataFrame:
        """(id, label, features, ..., probability, prediction) of decoded records."""
        return self.forest.transform(record_vectors(m, self.keys, self.id_col))


# ---- categories -----------------------------------------------------------------


def category_dictionary(df: DataFrame, cols: list[str]) -> dict[str, DataFrame]:
    """Per column (key, slot, n) of its values in sorted order; a missing one counts as 'unknown'."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("key")
    return {c: number_keys(df.groupBy(value(c)).agg(F.count("*").alias("n")), "key") for c in cols}


def one_hot_slots(
    df: DataFrame, numeric: list[str], cats: dict[str, DataFrame], output: str = "features", broadcast_bytes: int | None = None
) -> DataFrame:
    """`df` with a sparse vector in stored form: the numeric columns, then a slot per category in the order of `cats`.

    A value that was not fitted has no slot, a missing one that of 'unknown'; a number that is missing or 0 takes no room.
    """
    first, slots, out = len(numeric), [], df
    for i, (c, keys) in enumerate(cats.items()):
        name = f"_slot{i}"
        out = look_up(out, F.coalesce(F.col(c).cast("string"), F.lit("unknown")), keys, name, broadcast_bytes)
        slots.append(F.struct((F.col(name) + F.lit(first)).alias("slot"), F.lit(1.0).alias("value")))
        first += keys.count()
    numbers = [F.struct(F.lit(i).alias("slot"), F.col(c).cast("double").alias("value")) for i, c in enumerate(numeric)]
    taken = F.filter(F.array(*numbers, *slots), lambda e: e["slot"].isNotNull() & (e["value"] != 0))
    packed = out.withColumn("_e", taken)
    vector = sparse_vector(F.lit(first), F.col("_e.slot"), F.col("_e.value")).alias(output)
    return packed.select(*df.columns, vector)


def one_hot_vectors(df: DataFrame, numeric: list[str], cats: dict[str, DataFrame], output: str = "features") -> DataFrame:
    """`one_hot_slots` with a vector column."""
    return as_vectors(one_hot_slots(df, numeric, cats, output), output)
