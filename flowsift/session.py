"""Session defaults and the shared working folder."""

from __future__ import annotations

import contextlib
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(app: str = "flowsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` adds or overrides."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    A folder of our own is used only in local mode with the setting absent (tests).
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="flowsift-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return os.path.join(shared_dir(spark), "flowsift", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, for results that are read several times.

    Later reads prune columns and survive lost executors. The folder belongs to the
    application and can go when it ends.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs over rows of many columns: generated methods above 8000 bytes, which the JVM only interprets, are not used inside."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, 8000)
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


SMALL_BYTES = 128 * 1024 * 1024  # what one scan task reads by default
MAX_PIECES = 2_000  # the size is an estimate and may be far too high


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small batch input to several cores; larger inputs pass unchanged.

    Catalyst's own size estimate decides, so nothing runs and at most SMALL_BYTES are shuffled.
    Row order is not kept.
    """
    if df.isStreaming:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SMALL_BYTES:
        return df
    return df.repartition(min(64, df.sparkSession.sparkContext.defaultParallelism))


def dealt(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Deal the rows of an input of any size to all cores, for costly work or several passes behind it.

    A large table in few files or row groups, or with one of them larger than the rest, keeps
    few cores busy in every pass. Each row is shuffled once; row order is not kept. A frame with
    joins has no usable size estimate: `source`, with about as many bytes, gives one instead.
    """
    if df.isStreaming:
        return df
    size = int(str((df if source is None else source)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(min(64, cores), min(MAX_PIECES, math.ceil(size / SMALL_BYTES))))
