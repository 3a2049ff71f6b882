"""The record log: one Parquet table, partitioned by dataset and upload batch."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.functions import dataset_id
from flowsift.operators.features import column_names
from flowsift.operators.grid import search_any
from flowsift.operators.position import KeyRange, Page, dense_position, number_rows, page, page_bounds, page_info
from flowsift.operators.split import assign_split
from flowsift.operators.stats import COUNTS, add_counts, typed_counts
from flowsift.schema import RECORDS, TESTING, TRAINING
from flowsift.session import written
from flowsift.sources.csv_lines import row_document, scan_records
from flowsift.sources.decode import decode_records, parse_document
from flowsift.sources.text_index import batches_with, text_maps, wanted_bits


def dataset_name(spark: SparkSession, name: str | None) -> str:
    return spark.range(1).select(dataset_id(F.lit(name).cast("string"))).first()[0]


def read_log(spark: SparkSession, table: str) -> DataFrame:
    """Whole log; an absent table is an empty log."""
    try:
        return spark.read.schema(RECORDS).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORDS)


def dataset_scan(spark: SparkSession, table: str, dataset: str | None = None) -> DataFrame:
    """Rows of one dataset; the partition filter prunes all other files."""
    return read_log(spark, table).where(F.col("dataset") == dataset_name(spark, dataset))


def split_scan(rec: DataFrame, part: str) -> DataFrame:
    """Rows of one split. Not ordered: a scan needs no global sort, `page` orders."""
    if part not in (TRAINING, TESTING):
        raise ValueError(f"part must be {TRAINING!r} or {TESTING!r}")
    return rec.where(F.col("T") == part)


def require_split(rec: DataFrame) -> DataFrame:
    """Fail for a log that has rows but never got training/testing labels."""
    if rec.where(F.col("T").isNotNull()).isEmpty() and not rec.isEmpty():
        raise ValueError("dataset has no training/testing labels: assign a split first")
    return rec


#: Behind a dataset's name, the partitions of its rejects, type counts, id ranges and text maps; dataset names end in .db.
REJECTS, TYPES, INDEX, SEARCH = ".rejects", ".types", ".index", ".search"
_RANGE = ("min(id) AS low", "max(id) AS high", "count(*) AS n")
_TYPE_COUNTS = ", ".join(["type string", *[f"{c} long" for c in COUNTS]])


def _csv_path(path: str) -> str:
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError("file must be a CSV file")
    return path


def read_record_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as texts: '' for an empty cell, null for a cell a short row lacks.

    Quoted cells may hold line breaks. Bytes that are not UTF-8 are an error. Columns with
    equal names get a number; surplus cells have no column (`ingest_csv` keeps them).
    """
    names, rows = scan_records(spark, _csv_path(path))
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(column_names(names))])


def to_row_data(df: DataFrame, cols: list[str] | None = None) -> Column:
    """One JSON object per row, every value a text, missing ones null."""
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in cols or df.columns]
    return F.to_json(F.struct(*texts), {"ignoreNullFields": "false"})


def next_id(spark: SparkSession, table: str, dataset: str, batch: str | None = None) -> int:
    """One after the largest id of the dataset, rows of `batch` itself left aside."""
    log = read_log(spark, table).where(F.col("dataset") == dataset)
    if batch is not None:
        log = log.where(F.col("batch") != batch)
    return (log.agg(F.max("id")).first()[0] or 0) + 1


def number_records(df: DataFrame, start: int, order_col: str | None, position_col: str | None = None) -> DataFrame:
    """Add consecutive ids by a unique column or by positions from 0, or in arrival order when there is neither."""
    if position_col is not None:
        return df.withColumn("id", F.col(position_col) + F.lit(start)).drop(position_col)
    if order_col is None:
        return number_rows(df, start, "id")
    return dense_position(df, order_col, start, "_id").drop(order_col).withColumnRenamed("_id", "id")


def write_batch(
    df: DataFrame,
    table: str,
    dataset: str,
    batch: str,
    ts: dt.datetime,
    order_col: str | None = None,
    position_col: str | None = None,
    rejects: DataFrame | None = None,
    count_types: bool = True,
    map_texts: bool = False,
) -> int:
    """Write `row_data` rows as one batch in one commit; a repeated batch replaces itself.

    rejects: (row_data, reason) of lines that are no records. They go to the same table in the
    same commit, in a partition that no dataset name can have; see `read_rejects`. So do the
    batch's type counts (`log_type_counts`), unless count_types is off, and its range of ids.
    map_texts stores maps of its texts too, which `log_search` uses; a relabelled dataset has none.
    """
    spark = df.sparkSession
    numbered = number_records(df, next_id(spark, table, dataset, batch), order_col, position_col)
    rows = numbered.select(
        "id",
        F.lit(ts).alias("upload_timestamp"),
        "row_data",
        F.lit(None).cast("string").alias("T"),
        F.lit(dataset).alias("dataset"),
        F.lit(batch).alias("batch"),
    )
    plain = written(rows, "batch")  # read for the rows, their counts and their ids
    rows = plain.unionByName(_index_rows(plain))
    if count_types:
        rows = rows.unionByName(_type_rows(plain))
    if map_texts:
        rows = rows.unionByName(_search_rows(plain))
    if rejects is not None:
        refused = rejects.select(
            F.lit(None).cast("long").alias("id"), F.lit(ts).alias("upload_timestamp"), "row_data",
            F.col("reason").alias("T"), F.lit(dataset + REJECTS).alias("dataset"), F.lit(batch).alias("batch"),
        )
        rows = rows.unionByName(refused)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "batch")
        .parquet(table)
    )
    stored = read_log(spark, table).where((F.col("dataset") == dataset) & (F.col("batch") == batch))
    return stored.count()


def _type_rows(rows: DataFrame) -> DataFrame:
    """The type counts of every (dataset, batch) of log rows, as rows of the log."""
    counts = typed_counts(rows, "dataset", "batch", "upload_timestamp")
    document = F.to_json(F.struct("type", *COUNTS))
    return counts.select(
        F.lit(None).cast("long").alias("id"), "upload_timestamp", document.alias("row_data"), F.lit(None).cast("string").alias("T"),
        F.concat("dataset", F.lit(TYPES)).alias("dataset"), "batch",
    )


def log_type_counts(spark: SparkSession, table: str, dataset: str | None = None) -> DataFrame:
    """Type counts of a dataset, for any of the type statistics, from the counts stored with its batches.

    Only batches without stored counts are parsed; their names come to the driver, no row does.
    """
    name, log = dataset_name(spark, dataset), read_log(spark, table)
    stored = log.where(F.col("dataset") == name + TYPES)
    batches = log.where(F.col("dataset") == name).select("batch").distinct()
    missing = [r["batch"] for r in batches.join(stored.select("batch").distinct(), "batch", "left_anti").collect()]
    counts = stored.select(F.from_json("row_data", _TYPE_COUNTS).alias("c")).select("c.*")
    if missing:
        parsed = typed_counts(log.where((F.col("dataset") == name) & F.col("batch").isin(missing)))
        counts = counts.unionByName(parsed)
    return add_counts(counts)


def _search_rows(rows: DataFrame) -> DataFrame:
    """The text maps of every (dataset, batch) of log rows, as rows of the log."""
    maps = text_maps(rows, "dataset", "batch", "upload_timestamp")
    return maps.select(
        F.lit(None).cast("long").alias("id"), "upload_timestamp",
        F.to_json(F.struct("bucket", F.base64("bits").alias("bits"))).alias("row_data"),
        F.lit(None).cast("string").alias("T"), F.concat("dataset", F.lit(SEARCH)).alias("dataset"), "batch",
    )


def log_search(spark: SparkSession, table: str, dataset: str | None, query: str) -> DataFrame:
    """Decoded rows of a dataset with `query` in any value; batches whose text maps rule it out are not read.

    Batches without maps are read, and all are for a query below three characters. The names of
    the batches to read come to the driver.
    """
    name, log = dataset_name(spark, dataset), read_log(spark, table)
    rows = log.where(F.col("dataset") == name)
    wanted = wanted_bits(spark, query)
    if wanted:
        stored = log.where(F.col("dataset") == name + SEARCH)
        parsed = stored.select("batch", F.from_json("row_data", "bucket int, bits string").alias("m"))
        maps = parsed.select("batch", "m.bucket", F.unbase64("m.bits").alias("bits"))
        unmapped = rows.select("batch").distinct().join(stored.select("batch").distinct(), "batch", "left_anti")
        near = [r["batch"] for r in batches_with(maps, wanted).unionByName(unmapped).collect()]
        rows = rows.where(F.col("batch").isin(near))
    return search_any(decode_records(rows), query)


def _index_rows(rows: DataFrame) -> DataFrame:
    """The range of ids and the number of rows of every (dataset, batch) of log rows, as rows of the log."""
    ranges = rows.groupBy("dataset", "batch", "upload_timestamp").agg(*map(F.expr, _RANGE))
    return ranges.select(
        F.lit(None).cast("long").alias("id"), "upload_timestamp", F.to_json(F.struct("low", "high", "n")).alias("row_data"),
        F.lit(None).cast("string").alias("T"), F.concat("dataset", F.lit(INDEX)).alias("dataset"), "batch",
    )


def log_index(spark: SparkSession, table: str, dataset: str | None = None) -> DataFrame:
    """(batch, low, high, n): the range of ids of every batch; only the ids of batches without a stored one are read."""
    name, log = dataset_name(spark, dataset), read_log(spark, table)
    stored = log.where(F.col("dataset") == name + INDEX)
    of_rows = log.where(F.col("dataset") == name)
    known = stored.select("batch", F.from_json("row_data", "low long, high long, n long").alias("r")).select("batch", "r.*")
    batches = of_rows.select("batch").distinct()
    missing = [r["batch"] for r in batches.join(stored.select("batch").distinct(), "batch", "left_anti").collect()]
    if missing:
        known = known.unionByName(of_rows.where(F.col("batch").isin(missing)).groupBy("batch").agg(*map(F.expr, _RANGE)))
    return known.where("n > 0")


def log_page(
    spark: SparkSession, table: str, dataset: str | None, limit: int, offset: int, default: int = 1000, cap: int | None = None
) -> Page:
    """One page of a dataset by id, however deep and whatever gaps its ids have.

    The index, one row per batch on the driver, tells which batches the page touches; only
    their files are read. Batches whose ids overlap are taken together.
    """
    limit, offset = page_bounds(limit, offset, default, cap)
    groups: list[list] = []  # low, high, rows, batches
    for r in log_index(spark, table, dataset).orderBy("low").collect():
        if groups and r["low"] <= groups[-1][1]:
            last = groups[-1]
            last[1], last[2] = max(last[1], r["high"]), last[2] + r["n"]
            last[3].append(r["batch"])
        else:
            groups.append([r["low"], r["high"], r["n"], [r["batch"]]])
    total, at, skipped, touched = sum(g[2] for g in groups), 0, 0, []
    for g in groups:
        if at < offset + limit and at + g[2] > offset:
            touched.append(g)
        elif not touched:
            skipped = at + g[2]
        at += g[2]
    of_rows = dataset_scan(spark, table, dataset)
    info = page_info(spark, total, limit, offset)
    if not touched:
        return Page(of_rows.where(F.lit(False)), info)
    span = KeyRange(touched[0][0], touched[-1][1], sum(g[2] for g in touched))
    near = of_rows.where(F.col("batch").isin([b for g in touched for b in g[3]]))
    return Page(page(near, limit, offset - skipped, span=span).rows, info)


def read_rejects(spark: SparkSession, table: str, dataset: str | None = None) -> DataFrame:
    """(batch, upload_timestamp, line, reason) of every line of the dataset's streams that is no record."""
    rows = read_log(spark, table).where(F.col("dataset") == dataset_name(spark, dataset) + REJECTS)
    return rows.select("batch", "upload_timestamp", F.col("row_data").alias("line"), F.col("T").alias("reason"))


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def ingest_records(
    df: DataFrame,
    table: str,
    dataset: str | None = None,
    ts: dt.datetime | None = None,
    order_col: str | None = None,
    batch: str | None = None,
) -> int:
    """Store a frame as records of texts; returns rows inserted.

    The batch shares one timestamp, continues the dataset's ids and appears as a
    whole or not at all. One writer per dataset at a time.
    """
    name = dataset_name(df.sparkSession, dataset)
    order = [] if order_col is None else [F.col(order_col).alias("_order")]
    rows = df.select(*order, to_row_data(df).alias("row_data"))
    return write_batch(
        rows, table, name, batch or uuid.uuid4().hex, ts or _now(), "_order" if order else None
    )


def ingest_csv(
    spark: SparkSession,
    path: str,
    table: str,
    dataset: str | None = None,
    ts: dt.datetime | None = None,
    batch: str | None = None,
) -> int:
    """Store a CSV file, or a folder of them, in the order of its records; returns rows inserted.

    Quoted cells may hold line breaks, and a large file is still read by several tasks.
    Surplus cells stay, as a list under the key "null".
    """
    names, rows = scan_records(spark, _csv_path(path))
    rows = rows.select("position", row_document(names).alias("row_data"))
    name = dataset_name(spark, dataset)
    return write_batch(rows, table, name, batch or uuid.uuid4().hex, ts or _now(), position_col="position")


def append_records(
    df_json: DataFrame,
    table: str,
    dataset: str | None = None,
    ts: dt.datetime | None = None,
    order_col: str | None = None,
    batch: str | None = None,
) -> int:
    """Store JSON objects as they are (column row_data); an empty or broken one fails the batch."""
    data = parse_document("row_data")
    if not df_json.where(F.coalesce(F.size(data), F.lit(0)) < 1).isEmpty():
        raise ValueError("every record must be a non-empty JSON object")
    name = dataset_name(df_json.sparkSession, dataset)
    order = [] if order_col is None else [F.col(order_col).alias("_order")]
    return write_batch(
        df_json.select(*order, "row_data"),
        table, name, batch or uuid.uuid4().hex, ts or _now(), "_order" if order else None,
    )


def relabel_dataset(
    spark: SparkSession, table: str, dataset: str | None = None, frac: float = 0.3, seed: int = 42
) -> DataFrame:
    """Give every row of the dataset a new split, in place; returns the labelled rows.

    The labelled copy is written aside before it replaces the partitions it was read from.
    """
    rows = written(assign_split(dataset_scan(spark, table, dataset), frac, seed), "labelled")
    (
        rows.unionByName(_type_rows(rows)).unionByName(_index_rows(rows)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "batch")
        .parquet(table)
    )
    return dataset_scan(spark, table, dataset)


def clear_dataset(spark: SparkSession, table: str, dataset: str | None = None) -> DataFrame:
    """Delete the dataset's rows and what is stored beside them, so that ids start at 1 again; returns (rows_deleted)."""
    name = dataset_name(spark, dataset)
    n = dataset_scan(spark, table, dataset).count()
    for part in (name, *(name + beside for beside in (REJECTS, TYPES, INDEX, SEARCH))):
        if not read_log(spark, table).where(F.col("dataset") == part).isEmpty():
            empty = spark.createDataFrame([], RECORDS).drop("dataset")
            empty.write.mode("overwrite").partitionBy("batch").parquet(os.path.join(table, f"dataset={part}"))
    return spark.createDataFrame([(n,)], "rows_deleted long")
