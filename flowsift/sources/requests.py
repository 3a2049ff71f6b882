"""Score requests in, score documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.functions import flag, strip
from flowsift.sources.decode import JSON_MAP, JSON_OPTIONS, parse_document


def read_score_requests(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Records to score as a map column `data`, with `error` for requests that cannot be read.

    lines=True reads JSON Lines, which splits; lines=False reads whole files holding
    one object or one list of objects; such a file is one row until it is read. An
    unreadable request keeps its row with null data. Blank lines and files are no requests.
    """
    texts = spark.read.text(path, wholetext=not lines).where(strip("value") != "")
    single = parse_document("value")
    if lines:
        found = texts.select(single.alias("data"))
    else:
        several = F.from_json("value", f"array<{JSON_MAP}>", JSON_OPTIONS)
        found = texts.select(F.explode(F.coalesce(several, F.array(single))).alias("data"))
    return found.select("data", F.when(F.col("data").isNull(), "request is no JSON object").alias("error"))


def score_document(
    sc: DataFrame,
    request_id: str,
    version: str,
    threshold: float,
    n: int = 10,
    id_col: str = "event_id",
    score: str = "score",
) -> DataFrame:
    """One JSON document with the first n scored rows by id."""
    first = sc.orderBy(id_col).limit(n)
    result = F.struct(
        F.col(id_col).alias("event_id"),
        F.col(score).alias("anomaly_score"),
        flag(score, threshold).alias("anomaly_flag"),
    )
    document = F.struct(
        F.lit(request_id).alias("request_id"),
        F.lit(version).alias("model_version"),
        F.lit(float(threshold)).alias("threshold"),
        F.col("results"),
    )
    return first.agg(F.array_sort(F.collect_list(result)).alias("results")).select(
        F.to_json(document).alias("document")
    )
