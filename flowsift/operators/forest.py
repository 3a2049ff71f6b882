"""Random-forest training, scoring and evaluation with MLlib and node tables."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from flowsift.functions import label_name, parse_number
from flowsift.functions.text import NUMBER, WHITESPACE
from flowsift.operators.features import column_names, record_feature_keys
from flowsift.operators.growth import BINS, grow_forest
from flowsift.operators.metrics import confusion_matrix, metrics_of, ranking_metrics
from flowsift.operators.nodes import LEAF_BYTES, MAX_DEPTH, NodeForest, grow_to_purity, model_nodes, node_importances
from flowsift.operators.sparse import SparseForest, record_dictionary, record_vectors
from flowsift.schema import CATEGORICAL, LABEL_NAMES, MODEL_RUN
from flowsift.session import spread, written


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight) with weight = n / (classes * rows of the class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.select("label", (total / (classes * F.col("n"))).alias("weight"))


def _weight_column(weights: dict[float, float], label: str) -> Column:
    out = F.lit(1.0)
    for value, weight in weights.items():
        out = F.when(F.col(label) == value, weight).otherwise(out)
    return out


def _has_categories(df: DataFrame, col: str) -> bool:
    """Whether a slot of the vector counts categories, of which any set may go left; those of two are cut as numbers."""
    return bool(df.schema[col].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal"))


def _forest(trees: int, depth: int, seed: int, **more: Any) -> RandomForestClassifier:
    if depth > MAX_DEPTH:
        raise ValueError(f"a tree of depth {depth} is asked for; MLlib grows at most {MAX_DEPTH} levels")
    return RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        minInstancesPerNode=1,
        seed=seed,
        bootstrap=trees > 1,  # a single tree takes every row
        cacheNodeIds=depth > 10,
        checkpointInterval=10,
        **more,
    )


def train_forest(
    df: DataFrame,
    trees: int = 200,
    depth: int = 20,
    weighted: bool = True,
    seed: int = 42,
    features: str = "features",
    label: str = "label",
) -> RandomForestClassificationModel:
    """Forest on a prepared vector column."""
    data = spread(df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label")))
    by_class = {r["label"]: r["weight"] for r in class_weights(data).collect()} if weighted else {}  # one row per class
    more = {"weightCol": "weight"} if weighted else {}
    if depth and not _has_categories(data, "features"):
        return grow_forest(data, _forest(trees, depth, seed, maxBins=BINS, **more), by_class)
    return _forest(trees, depth, seed, **more).fit(data.withColumn("weight", _weight_column(by_class, "label")))


def _sql_text(text: str) -> str:
    return "'" + re.sub(r"(['\\])", r"\\\1", text) + "'"


def _numbers_sql(value: str) -> str:
    trimmed = f"btrim({value}, {_sql_text(WHITESPACE)})"
    return f"CASE WHEN {trimmed} RLIKE {_sql_text(NUMBER)} THEN try_cast({trimmed} AS DOUBLE) END"


def _record_stages(
    m: DataFrame, keys: list[str], text_keys: list[str]
) -> tuple[list[Any], DataFrame, list[str], list[str], int]:
    """Stages that turn records into the column `features`, fitted on the records with a label.

    Also those records as columns, the columns' names, the inputs of the vector, and the most
    values a text key has.
    """
    names = [f"x_{n}" for n in column_names(keys)]
    parts = []
    for key, name in zip(keys, names):
        value = f"try_element_at(data, {_sql_text(key)})"
        if key in text_keys:
            parts.append(f"coalesce({value}, 'unknown') AS `{name}`")
        else:
            parts.append(f"coalesce({_numbers_sql(value)}, 0.0D) AS `{name}`")
    extract = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")

    label = parse_number(F.try_element_at(F.col("data"), F.lit("label"))).cast("int")
    known = m.select("data", label.cast("double").alias("label")).where(F.col("label").isNotNull())
    # Indexing, split finding and tree building each read the rows; the documents are parsed once.
    wide = spread(extract.transform(known).select(*[f"`{n}`" for n in names], "label"))
    plain = wide.toDF(*[f"c{i}" for i in range(len(wide.columns))])
    data = written(plain, "training").toDF(*wide.columns)

    stages: list[Any] = [extract]
    inputs, arity = list(names), 2
    texts = [n for k, n in zip(keys, names) if k in text_keys]
    if texts:
        indexed = [f"i{n}" for n in texts]
        indexer = StringIndexer(
            inputCols=texts, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"
        ).fit(data)
        data = indexer.transform(data)
        stages.append(indexer)
        inputs = [f"i{n}" if n in texts else n for n in names]
        arity = max(len(labels) + 1 for labels in indexer.labelsArray)
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    return [*stages, assembler], assembler.transform(data).select("features", "label"), names, inputs, arity


def record_front(m: DataFrame, features: list[str], categorical_keys: list[str] = CATEGORICAL) -> PipelineModel:
    """The stages before the forest alone: records to the vector column `features`, in the given order of keys."""
    stages, *_ = _record_stages(m, features, [k for k in features if k in categorical_keys])
    return PipelineModel(stages)


def train_record_forest(
    df: DataFrame,
    trees: int = 100,
    depth: int | None = None,
    categorical: str = "index",
    seed: int = 42,
    features: list[str] | None = None,
    categorical_keys: list[str] = CATEGORICAL,
    levels: int | None = None,
) -> PipelineModel | NodeForest:
    """Forest on decoded records (map column `data`).

    depth=None grows every tree until its leaves are pure or hold rows that are alike, which
    gives a node forest: `levels` of them level by level over all rows, the rest leaf by leaf.
    By default as many as bring a balanced tree's leaves well below what a task grows, at
    least 8. A number of levels as depth gives an MLlib pipeline.

    The fitted model takes records as they are: it looks up the training keys, reads
    numbers, and fills what is missing with 0, so batch, stream and reloaded models
    align features alike. 'index' keeps text keys as categories; 'zero' turns their
    values into numbers, that is into 0.
    """
    if categorical not in ("index", "zero"):
        raise ValueError("categorical must be 'index' or 'zero'")
    # A filter would be moved below the input's own shuffle and parse there: written down, each document is parsed once.
    df = written(df, "records")
    keys = record_feature_keys(df) if features is None else features
    text_keys = [k for k in keys if categorical == "index" and k in categorical_keys]
    stages, vectors, names, inputs, arity = _record_stages(df, keys, text_keys)
    if depth is None and levels is None:
        leaves = vectors.count() * (8 * len(inputs) + 32) / LEAF_BYTES
        levels = min(MAX_DEPTH, max(8, 3 + math.ceil(math.log2(max(1.0, leaves)))))
    forest = _forest(trees, levels if depth is None else depth, seed, maxBins=max(32, arity)).fit(vectors)
    if depth is None:
        rows = vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("label").cast("int"),
            F.lit(1.0).alias("weight"),
            vector_to_array("features").alias("x"),
        )
        nodes = grow_to_purity(model_nodes(forest), written(rows, "vectors"), seed)
        return NodeForest(nodes, PipelineModel(stages))
    dropped = ", ".join(f"`{c}`" for c in dict.fromkeys(names + inputs))
    tidy = SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}) FROM __THIS__")
    return PipelineModel([*stages, forest, tidy])


def train_sparse_forest(
    m: DataFrame, trees: int = 100, depth: int = MAX_DEPTH, seed: int = 42, id_col: str = "id"
) -> SparseForest:
    """Forest on decoded records with any number of keys; all values are read as numbers, as with 'zero'."""
    keys = record_dictionary(m, id_col)
    known = record_vectors(m, keys, id_col).where(F.col("label").isNotNull())
    return SparseForest(keys, _forest(trees, depth, seed).fit(known.withColumn("label", F.col("label").cast("double"))), id_col)


def forest_of(model: Any) -> RandomForestClassificationModel | NodeForest:
    if isinstance(model, PipelineModel):
        return next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))
    if isinstance(model, SparseForest):
        return model.forest
    return model


def vector_names(df: DataFrame, col: str = "features") -> list[str]:
    """Names of the vector's slots by attribute index, not by the grouping of the metadata."""
    attrs = df.schema[col].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a.get("name", f"feat_{a['idx']}")) for group in attrs.values() for a in group)
    return [re.sub(r"^(_n_|_h_|i?x_)", "", name) for _, name in slots]


def importance_topk(model: Any, names: list[str], k: int | None = 10, spark: SparkSession | None = None) -> DataFrame:
    """(feature, importance), most important first; k=None lists all."""
    spark = spark or SparkSession.active()
    found = forest_of(model)
    if isinstance(found, NodeForest):
        slots = spark.createDataFrame(list(enumerate(names)), "slot int, feature string")
        weights = slots.join(node_importances(found.nodes), "slot", "left")
        ranked = weights.select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    else:
        rows = [(n, float(w)) for n, w in zip(names, found.featureImportances.toArray())]
        ranked = spark.createDataFrame(rows, "feature string, importance double")
    ranked = ranked.orderBy(F.desc("importance"), "feature")
    return ranked if k is None else ranked.limit(k)


def score(model: Any, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, score): share of class 1, averaged over the trees."""
    p = vector_to_array("probability")
    return model.transform(df).select(id_col, p[1].alias("score"))


def predict(model: PipelineModel | NodeForest, m: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """prediction, label, probability_safe, probability_unsafe, confidence per record."""
    p = vector_to_array("probability")
    scored = model.transform(m).select(*keep, F.col("prediction").cast("int"), p.alias("p"))
    return scored.select(
        *keep,
        "prediction",
        label_name("prediction").alias("label"),
        F.col("p")[0].alias("probability_safe"),
        F.col("p")[1].alias("probability_unsafe"),
        F.array_max("p").alias("confidence"),
    )


def evaluate(
    model: Any,
    df: DataFrame,
    label: str | Column = "label",
    model_name: str = "random-forest",
    names: list[str] | None = None,
    params: dict[str, Any] | None = None,
    threshold: float | None = None,
    topk: int | None = 20,
) -> DataFrame:
    """One model-run row: metrics, importances, parameters. Rows are scored once."""
    spark = df.sparkSession
    y = (F.col(label) if isinstance(label, str) else label).cast("int").alias("y")
    p = vector_to_array("probability")[1]
    pred = F.col("prediction").cast("int") if threshold is None else (p >= threshold).cast("int")
    out = model.transform(df.withColumn("_y", y))
    names = names or vector_names(out)
    sc = out.select(F.col("_y").alias("y"), p.alias("score"), pred.alias("pred"))
    sc = sc.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known = sc.where(F.col("y").isNotNull())  # behind the stored rows, so that no document is parsed for it again
        cm = confusion_matrix(known).first()
        basic = metrics_of(spark.createDataFrame([cm])).first()
        ranked = ranking_metrics(known).first()
    finally:
        sc.unpersist()
    top = [(r["feature"], r["importance"]) for r in importance_topk(model, names, topk, spark).collect()]
    metrics = (
        basic["accuracy"],
        basic["precision"],
        basic["recall"],
        basic["f1_score"],
        ranked["roc_auc"],
        ranked["average_precision"],
        [[cm["tn"], cm["fp"]], [cm["fn"], cm["tp"]]],
        top,
    )
    return run_row(spark, model_name, names, params or {}, metrics)


def run_row(
    spark: SparkSession, model: str, names: list[str], params: dict[str, Any], metrics: tuple | None
) -> DataFrame:
    """A row for the run table; metrics stay null between training and the first test."""
    labels = {str(k): v for k, v in LABEL_NAMES.items()}
    texts = {k: None if v is None else str(v) for k, v in params.items()}
    row = (model, None, "RandomForestClassifier", names, len(names), texts, metrics, labels)
    return spark.createDataFrame([row], MODEL_RUN).withColumn("logged_at", F.current_timestamp())
