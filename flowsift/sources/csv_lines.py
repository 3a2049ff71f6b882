"""CSV files with quoted line breaks, read by all tasks at once.

Whether a line begins inside a quoted cell depends on every line of the file before it.
Each block of a file is therefore scanned under both assumptions; what a block does to
either is one row on the driver, which finds the true state at every block's beginning. A
second pass takes the lines as they truly are: a line that begins and ends outside is a
record, the lines of longer records are put together by record number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.functions.csv import leaves_open, split_cells
from flowsift.session import written

#: What a line is to its record: one of its several lines, all of it, or blank and outside.
PART, WHOLE, BLANK = 0, 1, 2

_SCANNED = (
    "part int, block int, line long, path string, start long, text string, "
    "nth_out long, kind_out int, after_out boolean, nth_in long, kind_in int, after_in boolean"
)


class _Walk:
    """One assumption about a block's beginning, carried from batch to batch."""

    def __init__(self, inside: bool):
        self.inside, self.records = inside, 0

    def take(self, if_out: np.ndarray, if_in: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per line: records begun so far, kind, state behind it; from what it does to either state."""
        at = np.arange(len(if_out))
        last = np.maximum.accumulate(np.where(if_out == if_in, at, -1))  # the last line that ignores its state
        turns = np.cumsum(if_out & ~if_in)
        known = last >= 0
        base = np.where(known, if_out[last], self.inside)
        after = base ^ ((turns - np.where(known, turns[last], 0)) % 2 == 1)
        before = np.concatenate(([self.inside], after[:-1]))
        nth = self.records + np.cumsum(~before & ~blank)
        kind = np.where(before | after, PART, np.where(blank, BLANK, WHOLE))
        self.inside, self.records = bool(after[-1]), int(nth[-1])
        return nth, kind, after


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one partition in order -> their place and both readings. Texts pass through unread."""
    block, here, line, walks = -1, None, 0, ()
    for batch in batches:
        part, path, start = (batch.column(i) for i in range(3))
        flags = [batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6)]
        codes = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = start.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(codes)]):
            if a == b:
                continue
            if (this := (path[a].as_py(), int(starts[a]))) != here:
                here, block, line, walks = this, block + 1, 0, (_Walk(False), _Walk(True))
            n = b - a
            read = [pa.array(x) for walk in walks for x in walk.take(*(f[a:b] for f in flags))]
            read = [x.cast(pa.int32()) if i in (1, 4) else x for i, x in enumerate(read)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.slice(a, n), pa.array(np.full(n, block, np.int32)), pa.array(line + np.arange(n)),
                    path.slice(a, n), start.slice(a, n), batch.column(3).slice(a, n), *read,
                ],
                names=[c.split()[0] for c in _SCANNED.split(", ")],
            )
            line += n


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its block and its two readings, written down, so that blocks stay as they were cut."""
    text = F.col("value")
    lines = spark.read.text(path, lineSep="\n").select(
        F.spark_partition_id().alias("part"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        text,
        leaves_open(text, False).alias("if_out"),
        leaves_open(text, True).alias("if_in"),
        text.rlike("^\r*$").alias("blank"),
    )
    return written(lines.mapInArrow(_scan, _SCANNED), "csv-lines")


def compose_blocks(blocks: list[dict]) -> list[tuple]:
    """Per block: part, block, its rank, truly begins inside, records before it, the file's first record, headers so far.

    blocks: one dict per block with path, start, and for both readings the records and the state behind it.
    """
    out, records, headers, inside, first, file = [], 0, 0, False, 0, None
    for rank, b in enumerate(sorted(blocks, key=lambda b: (b["path"], b["start"]))):
        if b["path"] != file:
            file, inside, first = b["path"], False, records
        begun = b["nth_in"] if inside else b["nth_out"]
        headers += records == first and begun > 0
        out.append((b["part"], b["block"], rank, inside, records, first, headers))
        records += begun
        inside = b["after_in"] if inside else b["after_out"]
    return out


def _records(scanned: DataFrame) -> DataFrame:
    """(position, text): every record; position counts data records from 0, a file's header is at -1."""
    spark = scanned.sparkSession
    per_block = scanned.groupBy("part", "block").agg(
        F.max("path").alias("path"),
        F.max("start").alias("start"),
        *[F.max(f"nth_{w}").alias(f"nth_{w}") for w in ("out", "in")],
        *[F.max_by(f"after_{w}", "line").alias(f"after_{w}") for w in ("out", "in")],
        F.bool_and(F.is_valid_utf8("text")).alias("valid"),
    )
    # One row per block of the files comes to the driver and is broadcast again.
    blocks = [r.asDict() for r in per_block.collect()]
    if not all(b["valid"] for b in blocks):
        raise ValueError("file must be UTF-8 encoded")
    placed = compose_blocks(blocks)
    table = spark.createDataFrame(
        placed, "part int, block int, rank long, inside boolean, before long, first long, headers long"
    )
    true = lambda name: F.when(F.col("inside"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))

    def lines(of: DataFrame) -> DataFrame:
        record = F.col("before") + true("nth") - 1
        position = F.when(record == F.col("first"), F.lit(-1)).otherwise(record - F.col("headers"))
        return of.join(F.broadcast(table), ["part", "block"]).select(
            true("kind").alias("kind"), record.alias("record"), position.alias("position"), "rank", "line", "text"
        )

    # Where no block begins inside a cell, this filter reaches the scan.
    some = F.col("kind_out") == PART
    if any(inside for _, _, _, inside, *_ in placed):
        some = some | (F.col("kind_in") == PART)
    whole = lines(scanned).where(F.col("kind") == WHOLE).select("position", "text")
    parts = lines(scanned.where(some)).where(F.col("kind") == PART)
    gathered = parts.groupBy("record", "position").agg(F.array_sort(F.collect_list(F.struct("rank", "line", "text"))).alias("l"))
    joined = gathered.select("position", F.array_join(F.col("l.text"), "\n").alias("text"))
    return whole.unionByName(joined)


def scan_records(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(header names, (position long, cells array<string>)) of a CSV file or a folder of them.

    position counts the data records from 0, files in the order of their names. Blank lines
    outside quotes are no records. All files must have the same header. A record must fit
    a row; files of any size are read by several tasks. A quoted cell that is not closed
    runs to the end of its file.
    """
    records = _records(scan_lines(spark, path))
    header = F.col("position") == -1
    headers = records.where(header).select(split_cells(F.col("text")).alias("names")).distinct().limit(2).collect()
    if not headers:
        raise ValueError("uploaded file is empty")
    if len(headers) > 1:
        raise ValueError("the files have different headers")
    return headers[0]["names"], records.where(~header).select("position", split_cells(F.col("text")).alias("cells"))


def row_document(names: list[str], cells: str = "cells") -> Column:
    """One JSON object per record: texts by header name, null for a cell that a short row lacks.

    Of equal names the last one's cell counts. Surplus cells are a list under the key null,
    which a document writes as a text.
    """
    place = {name: i for i, name in enumerate(names)}
    value = [F.get(F.col(cells), F.lit(i)).alias(name) for name, i in place.items()]
    document = F.to_json(F.struct(*value), {"ignoreNullFields": "false"})
    surplus = F.to_json(F.slice(F.col(cells), len(names) + 1, F.greatest(F.size(cells), F.lit(1))))
    longer = F.concat(F.substring(document, F.lit(1), F.length(document) - 1), F.lit(',"null":'), surplus, F.lit("}"))
    return F.when(F.size(cells) > len(names), longer).otherwise(document)
