"""Concatenate and cut: all documents as one token stream, cut into windows of one length.

Pass one encodes each document once and writes its ids with its place inside the task's
partition. The partitions' totals give each partition's offset in the stream. Pass two
cuts every document at the window boundaries; a cut document has boundary records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import store
from flowsift.llm.tokens import Words, encode_step, in_steps, load_tokenizer

WINDOW = 2048
END_OF_TEXT = 1

def encode_documents(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int = END_OF_TEXT) -> DataFrame:
    """(doc_id, part, before, n, ids): each document's ids and `end_id`, `before` counted inside partition `part`.

    ids are little-endian unsigned 32-bit numbers.

    Written to the shared folder: a retried task of pass two reads what pass one has
    fixed, and nothing is encoded twice.
    """

    def encode(batches):
        words, before = Words(load_tokenizer(tokenizer_path)), 0
        for batch in (step for whole in batches for step in in_steps(whole, 1)):
            flat, sizes = encode_step(words, batch.column(1), end_id)
            ends = np.cumsum(sizes)
            bounds = np.concatenate(([0], 4 * ends))
            ids = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(flat.astype("<u4", copy=False))]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(before + ends - sizes), pa.array(sizes), ids.cast(pa.binary())],
                names=["doc_id", "part", "before", "n", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    picked = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.spark_partition_id().alias("part"),
    )
    tokens = picked.mapInArrow(encode, "doc_id long, part int, before long, n long, ids binary")
    return store(tokens, "tokens")[0]


def with_offsets(tokens: DataFrame) -> DataFrame:
    """`tokens` with `position`, the number of ids in the whole stream before each document.

    One total per partition comes to the driver: 16 bytes for each task of pass one. The
    table of offsets has as many rows, which is the bound for broadcasting it.
    """
    spark = tokens.sparkSession
    totals = sorted(tokens.groupBy("part").agg(F.sum("n")).collect())
    offsets, at = [], 0
    for part, n in totals:
        offsets.append((part, at))
        at += n
    table = spark.createDataFrame(offsets, "part int, first long")
    return tokens.join(F.broadcast(table), "part").withColumn("position", F.col("first") + F.col("before")).drop("first")


def pack(
    docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, window: int = WINDOW, end_id: int = END_OF_TEXT
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, continued, continues, ids.

    ids are little-endian unsigned 32-bit numbers. `continued`: an earlier window holds the
    document's part before; `continues`: the next window holds the rest. Every id lies in
    one piece and every window but the last is full. A null or empty text is its end
    id alone; null and repeated doc_ids keep rows of their own; no documents, no rows.
    """

    tokens = with_offsets(encode_documents(docs, id_col, text_col, tokenizer_path, end_id))
    position, n, w = F.col("position"), F.col("n"), F.lit(window)
    number = lambda x: F.floor(x / w) if window & (window - 1) else F.shiftright(x, window.bit_length() - 1)

    def piece(sequence):
        begin = F.greatest(sequence * w, position) - position
        stop = F.least((sequence + 1) * w, position + n) - position
        return F.struct(
            begin.alias("start"),
            (stop - begin).alias("length"),
            sequence.alias("sequence_id"),
            (begin + position - sequence * w).alias("offset"),
            (stop < n).alias("continues"),
            F.substring("ids", (begin * 4 + 1).cast("int"), ((stop - begin) * 4).cast("int")).alias("ids"),
        )

    # The pieces are cut before the explode, so that a long document's ids are not repeated for each.
    cut = F.transform(F.sequence(number(position), number(position + n - 1)), piece)
    out = tokens.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(cut).alias("p"))
    return out.select(
        "doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset",
        (F.col("p.start") > 0).alias("continued"), "p.continues", "p.ids",
    )
