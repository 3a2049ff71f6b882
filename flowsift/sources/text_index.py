"""Which batches of a log can hold a text: a bit map of character triples per batch.

A search of three or more characters needs every triple of its text inside one value. The
triples of all values of a batch set bits of a map, which is stored in the batch's own
commit; batches that lack a bit are not read. Bits can be set by other triples, so what is
found is searched as ever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.sources.decode import decode_records

#: Characters that are looked up together, and bits of a batch's map: BUCKETS maps of 32,768 bits.
WIDTH, BUCKETS = 3, 32
_BITS = 32_768


def _pieces(text: Column) -> Column:
    """All runs of WIDTH characters of a lower-case text; none if it is shorter."""
    last = F.length(text) - F.lit(WIDTH - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(WIDTH)))).otherwise(
        F.array().cast("array<string>")
    )


def _place(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS * _BITS))


def text_maps(rows: DataFrame, *by: str) -> DataFrame:
    """(by, bucket, bits): the bit maps of the values of `row_data`, a broken document's as `decode_records` gives them.

    Triples are made distinct before the shuffle; a map has 4 KB, whatever the batch's size.
    """
    values = F.map_values("data")
    lowered = decode_records(rows.select(*by, "row_data")).select(*by, F.explode(F.filter(values, lambda v: F.length(v) >= WIDTH)).alias("v"))
    places = lowered.select(*by, F.explode(F.array_distinct(_pieces(F.lower("v")))).alias("p")).select(*by, _place(F.col("p")).alias("at"))
    bucket, bit = F.floor(F.col("at") / _BITS).cast("int"), F.pmod(F.col("at"), F.lit(_BITS))
    return places.groupBy(*by, bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def wanted_bits(spark: SparkSession, query: str) -> dict[int, list[int]]:
    """Bits by bucket that a batch with the text must have; none for texts shorter than WIDTH."""
    one = spark.range(1).select(_pieces(F.lit(query.lower())).alias("p")).select(F.array_distinct(F.transform("p", _place)).alias("at"))
    out: dict[int, list[int]] = {}
    for at in one.first()["at"]:
        out.setdefault(at // _BITS, []).append(at % _BITS)
    return out


def batches_with(maps: DataFrame, wanted: dict[int, list[int]]) -> DataFrame:
    """(batch) whose maps (batch, bucket, bits) have all wanted bits."""
    table = maps.sparkSession.createDataFrame([(b, sorted(at)) for b, at in wanted.items()], "bucket int, at array<int>")
    byte = lambda i: F.conv(F.hex(F.substring("bits", F.shiftright(i, 3) + 1, F.lit(1))), 16, 10).cast("int")
    has = F.forall("at", lambda i: byte(i).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(i, F.lit(8)))) != 0)
    hits = maps.join(F.broadcast(table), "bucket").where(has)
    return hits.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("batch")

