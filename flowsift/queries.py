"""Every operator as a query over the driver tables, with the same query in ANSI SQL.

A query takes (spark, sf_dir) and runs over whole tables. The SQL text reads the
tables by name; queries that SQL cannot express (fitted forests) have none.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift import functions as fn
from flowsift import schema
from flowsift.fixtures import FOREST_FEATURES, forest_nodes, forest_sql, table, view, view_sql
from flowsift.operators import features, flows, forest, grid, metrics, nodes, position, prep, sample, sparse, split, stats
from flowsift.plans.dashboard import sampled_type_stats
from flowsift.plans.offline import prepare_matrix
from flowsift.session import dealt, fresh_path, small_methods, spread, written
from flowsift.sources import matrix, models, records, requests
from flowsift.sources import flows as flow_source
from flowsift.sources.decode import decode_records
from flowsift.streaming import ingest_stream, predict_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str | tuple[str, str], ...] = ()) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            named = [(v, v) if isinstance(v, str) else v for v in views]
            ctes = [f"{cte} AS ({view_sql(v) if v in _BASE else DERIVED[v]})" for cte, v in named]
            kind = "WITH RECURSIVE" if "descent" in views else "WITH"
            ORACLES[name] = (f"{kind} {', '.join(ctes)}\n" if ctes else "") + sql.strip()
        return run

    return register


_BASE = ("fx_records", "fx_flows", "fx_scored", "fx_flow_records", "fx_raw_flows")

# Parts that several SQL texts share.
_NO_TYPE = ", ".join(f"'{t}'" for t in fn.types.NO_TYPE)
_RAW = {new: old for old, new in schema.RENAMES.items()}
_FLOW_COLUMNS = ", ".join(f"{_RAW.get(c, c)} AS {c}" for c in schema.FLOW_TYPES)
_DOUBLES = [c for c, t in schema.FLOW_TYPES.items() if t == "double"]
_TEXTS = [c for c, t in schema.FLOW_TYPES.items() if t == "string"]
_NUMBERS = [c for c, t in schema.FLOW_TYPES.items() if t != "string" and c not in ("id", "Label")]


def _clean(c: str) -> str:
    if c in _DOUBLES:
        return f"CASE WHEN isfinite({c}) THEN {c} END AS {c}"
    return f"coalesce({c}, 'unknown') AS {c}" if c in _TEXTS else c


_ENGINEERED = """
CAST(sbytes AS DOUBLE) / (CAST(dbytes AS DOUBLE) + 1) AS byte_ratio,
CAST(Spkts AS DOUBLE) / (CAST(Dpkts AS DOUBLE) + 1) AS pkt_ratio,
(CAST(sbytes AS DOUBLE) + CAST(dbytes AS DOUBLE)) / (dur + 1e-6) AS flow_rate,
(CAST(Spkts AS DOUBLE) + CAST(Dpkts AS DOUBLE)) / (dur + 1e-6) AS pkt_rate
"""


def _entries(view_name: str) -> str:
    return f"""
SELECT id, T, upload_timestamp, k, pos, json_extract_string(row_data, concat('$."', k, '"')) AS v
FROM (SELECT *, unnest(json_keys(row_data)) AS k, generate_subscripts(json_keys(row_data), 1) AS pos
      FROM {view_name} WHERE json_valid(row_data))"""


_DISPLAY = ",\n".join(
    f"""nullif(CASE WHEN max(CASE WHEN k = '{f}' THEN v END) <> '' THEN concat('=', trim(max(CASE WHEN k = '{f}' THEN v END)))
        ELSE first(trim(coalesce(v, 'null')) ORDER BY pos) FILTER (WHERE lower(k) = '{f.lower()}') END, '-') AS c{i}"""
    for i, f in enumerate(fn.types.DISPLAY_FIELDS)
)

def _number_sql(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({c}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
        f"THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    )


DERIVED = {
    "picked": """
SELECT id, block FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM fx_records) r
JOIN (SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS block, o FROM (
        SELECT DISTINCT CASE WHEN i = m - 1 THEN n - 100 ELSE i * (n // (m - 1)) END AS o
        FROM (SELECT count(*) AS n, least(50, count(*) // 100) AS m FROM fx_records), range(50) AS x(i) WHERE i < m)) b
ON p >= o AND p < o + 100""",
    "flows": f"SELECT {_FLOW_COLUMNS} FROM fx_raw_flows",
    "clean": f"SELECT {', '.join(_clean(c) for c in schema.FLOW_TYPES)} FROM flows",
    "ready": f"SELECT *, {_ENGINEERED} FROM clean",
    "small": f"SELECT * REPLACE (coalesce(service, 'unknown') AS service), {_ENGINEERED} FROM fx_flows",
    "entries": _entries("fx_records"),
    "flow_entries": _entries("fx_flow_records"),
    "typed": f"""
SELECT id, T, CASE WHEN lower(trim(raw)) NOT IN ({_NO_TYPE}) THEN trim(raw) END AS type, raw
FROM (SELECT r.id, r.T,
             coalesce(first(v ORDER BY pos) FILTER (WHERE lower(k) = 'type'),
                      first(v ORDER BY pos) FILTER (WHERE lower(k) IN ('label', 'category', 'class'))) AS raw
      FROM fx_records r LEFT JOIN entries e ON r.id = e.id GROUP BY r.id, r.T)""",
    "shown": f"""
SELECT id, upload_timestamp, T,
       coalesce(nullif(regexp_replace(coalesce(c0, c1, c2, c3, c4, c5, c6), '^=', ''), ''), '-') AS type
FROM (SELECT r.id, r.upload_timestamp, r.T, {_DISPLAY}
      FROM fx_records r LEFT JOIN entries e ON r.id = e.id GROUP BY r.id, r.upload_timestamp, r.T)""",
    "sc": "SELECT event_id, y, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM fx_scored",
    "cm": """
SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
       count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM sc""",
    "wide": """
SELECT r.id, max(CASE WHEN k = 'label' THEN v END) AS label, max(CASE WHEN k = 'dur' THEN v END) AS dur,
       max(CASE WHEN k = 'proto' THEN v END) AS proto, max(CASE WHEN k = 'rate' THEN v END) AS rate,
       max(CASE WHEN k = 'sbytes' THEN v END) AS sbytes
FROM fx_flow_records r LEFT JOIN flow_entries e ON r.id = e.id GROUP BY r.id""",
    # Rows going down the small forest: one row per record, tree and node on its way.
    "forest": forest_sql(),
    "descent": """
SELECT x.id, x.f, t.tree, CAST(0 AS BIGINT) AS node FROM x, (SELECT DISTINCT tree FROM forest) t
UNION ALL
SELECT d.id, d.f, d.tree,
       CASE WHEN CASE WHEN n.categories IS NULL THEN d.f[n.feature + 1] <= n.threshold
                      ELSE list_contains(n.categories, d.f[n.feature + 1]) END THEN n.lft ELSE n.rgt END
FROM descent d JOIN forest n ON n.tree = d.tree AND n.node = d.node WHERE n.feature IS NOT NULL""",
    "voted": """
SELECT id, avg(n.p) AS score FROM descent d JOIN forest n ON n.tree = d.tree AND n.node = d.node
WHERE n.feature IS NULL GROUP BY id""",
    # The features of records: numbers with 0 for what is none, texts by their place among the training rows' texts.
    "known": f"""
SELECT list(DISTINCT coalesce(proto, 'unknown') ORDER BY coalesce(proto, 'unknown')) AS protos
FROM wide JOIN fx_flow_records r ON r.id = wide.id WHERE r.T = 'training' AND {_number_sql("label")} IS NOT NULL""",
    "vectors": f"""
SELECT r.id, r.T, {_number_sql("label")} AS y,
       [coalesce({_number_sql("dur")}, 0), coalesce(list_position(protos, coalesce(proto, 'unknown')), len(protos) + 1) - 1,
        coalesce({_number_sql("sbytes")}, 0), coalesce({_number_sql("rate")}, 0)] AS f
FROM wide JOIN fx_flow_records r ON r.id = wide.id, known""",
    "all_records": "SELECT id, f FROM vectors",
    "test_records": "SELECT id, f FROM vectors WHERE T = 'testing'",
    "known_records": "SELECT id, f, y FROM vectors WHERE y IS NOT NULL",
    "voted_known": "SELECT y, score, CAST(score > 0.5 AS INT) AS pred FROM voted JOIN vectors USING (id) WHERE y IS NOT NULL",
    "passed": """
SELECT tree, node, count(*) AS n, (sum(CAST(y AS INT)) ** 2 + sum(1 - CAST(y AS INT)) ** 2) / CAST(count(*) AS DOUBLE) AS s
FROM descent JOIN x USING (id) GROUP BY tree, node""",
    "gained": """
SELECT f.tree, f.feature, coalesce(l.s, 0) + coalesce(r.s, 0) - p.s AS g FROM forest f
JOIN passed p ON p.tree = f.tree AND p.node = f.node
LEFT JOIN passed l ON l.tree = f.tree AND l.node = f.lft LEFT JOIN passed r ON r.tree = f.tree AND r.node = f.rgt
WHERE f.feature IS NOT NULL""",
    "flow_vectors": """
SELECT id, [dur, CASE proto WHEN 'arp' THEN 0 WHEN 'tcp' THEN 1 ELSE 2 END, CAST(sbytes AS DOUBLE), rate] AS f FROM ready""",
}
_VECTORS = ("fx_flow_records", "flow_entries", "wide", "known", "vectors", "forest")
_PREDICTED = """
SELECT id, CAST(score > 0.5 AS INT) AS prediction, CASE WHEN score > 0.5 THEN 'unsafe' ELSE 'safe' END AS label,
       1 - score AS probability_safe, score AS probability_unsafe, greatest(score, 1 - score) AS confidence FROM voted"""
_TYPED = ("fx_records", "entries", "typed")
_READY = ("fx_raw_flows", "flows", "clean", "ready")
_WIDE = ("fx_flow_records", "flow_entries", "wide")
_CM = ("fx_scored", "sc", "cm")


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return flows.rename_headers(view(spark, sf, "fx_raw_flows"))


def _ready(spark: SparkSession, sf: str) -> DataFrame:
    return flows.prepare_flows(_flows(spark, sf))


def _rec(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_records")


def _m(spark: SparkSession, sf: str, on_error: str = "keep") -> DataFrame:
    return decode_records(spread(_rec(spark, sf)), on_error)


def _flow_m(spark: SparkSession, sf: str) -> DataFrame:
    return decode_records(spread(view(spark, sf, "fx_flow_records")))


def _sc(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored").withColumn("pred", fn.flag("score"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


# ---- scans, sources, sinks -------------------------------------------------


@query("flow_csv_scan", "SELECT * FROM flows", ("fx_raw_flows", "flows"))
def flow_csv_scan(spark, sf):
    path = fresh_path(spark, "flows.csv")
    view(spark, sf, "fx_raw_flows").write.csv(path, header=True)
    return flow_source.read_flows(spark, path)


_EVENT_TEXT = """CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
       event_type, CAST(value AS VARCHAR) AS value, props"""


def _log_fields(log: DataFrame, keys: list[str]) -> DataFrame:
    return decode_records(log).select("id", "T", "dataset", *[F.col("data")[k].alias(k) for k in keys])


@query(
    "record_ingest",
    f"SELECT event_id + 1 AS id, CAST(NULL AS VARCHAR) AS T, 'events.db' AS dataset, {_EVENT_TEXT} FROM events",
)
def record_ingest(spark, sf):
    log = fresh_path(spark, "log")
    records.ingest_records(_events(spark, sf), log, "events", order_col="event_id")
    return _log_fields(
        records.dataset_scan(spark, log, "events"), ["event_id", "user_id", "event_type", "value", "props"]
    )


_NOTE = """concat(event_type, ',', chr(10), '"', props, '"', chr(10), CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(value AS {text}) END)"""


@query(
    "record_ingest_csv",
    f"""
SELECT event_id + 1 AS id, CAST(event_id AS VARCHAR) AS event_id, {_NOTE.format(text='VARCHAR')} AS note,
       CASE WHEN event_id % 7 = 0 THEN to_json(['more', chr(10)]) END AS surplus FROM events""",
)
def record_ingest_csv(spark, sf):
    """CSV text with line breaks, commas and quotes inside cells, and rows that are too long."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    note = quoted(F.expr(_NOTE.format(text="STRING")))
    longer = F.when(F.col("event_id") % 7 == 0, ',more,"\n"').otherwise("")
    line = F.concat(F.col("event_id"), F.lit(","), note, longer)
    path, log = fresh_path(spark, "events") + ".csv", fresh_path(spark, "log")
    file = F.lpad(F.floor(F.col("event_id") / 20_000).cast("string"), 12, "0").alias("file")  # files are read in the order of their names
    text = _events(spark, sf).select(file, "event_id", line.alias("line"))
    heads = text.select("file", F.lit(-1).cast("long").alias("event_id"), F.lit("event_id,note").alias("line")).distinct()
    whole = text.unionByName(heads).repartition("file").sortWithinPartitions("file", "event_id")
    whole.select("file", "line").write.partitionBy("file").text(path)
    records.ingest_csv(spark, path, log, "events")
    return decode_records(records.dataset_scan(spark, log, "events")).select(
        "id", *[F.col("data")[k].alias(n) for k, n in (("event_id", "event_id"), ("note", "note"), ("null", "surplus"))]
    )


@query(
    "record_append",
    """
SELECT event_id + 1 + b * (SELECT count(*) FROM events) AS id, 'events.db' AS dataset,
       json_extract_string(props, '$.k') AS k
FROM events, (SELECT 0 AS b UNION ALL SELECT 1) AS batches""",
)
def record_append(spark, sf):
    log = fresh_path(spark, "log")
    documents = _events(spark, sf).select("event_id", F.col("props").alias("row_data"))
    for _ in range(2):
        records.append_records(documents, log, "events.db", order_col="event_id")
    return decode_records(records.dataset_scan(spark, log, "events")).select(
        "id", "dataset", F.col("data")["k"].alias("k")
    )


@query(
    "record_ingest_stream",
    f"SELECT event_id + 1 AS id, CAST(NULL AS VARCHAR) AS T, 'stream.db' AS dataset, {_EVENT_TEXT} FROM events",
)
def record_ingest_stream(spark, sf):
    source, log = fresh_path(spark, "arriving"), fresh_path(spark, "log")
    texts = _events(spark, sf)
    texts = texts.select(*[F.col(c).cast("string") for c in texts.columns])
    texts.write.csv(source, header=True, escape='"')
    ingest_stream(
        spark, source, log, fresh_path(spark, "offsets"), "stream", schema=texts.schema, order_col="event_id"
    ).awaitTermination()
    return _log_fields(
        records.dataset_scan(spark, log, "stream"), ["event_id", "user_id", "event_type", "value", "props"]
    )


@query(
    "record_decode",
    """
SELECT id, pos, k, v FROM (SELECT id, CAST(pos AS INT) AS pos, k, v FROM entries
UNION ALL SELECT id, 1, 'error', 'Failed to parse row data' FROM fx_records WHERE NOT json_valid(row_data)
UNION ALL SELECT id, 2, 'raw', row_data FROM fx_records WHERE NOT json_valid(row_data))""",
    ("fx_records", "entries"),
)
def record_decode(spark, sf):
    exploded = _m(spark, sf).select("id", F.posexplode_outer("data").alias("pos", "k", "v"))
    return exploded.where(F.col("k").isNotNull()).withColumn("pos", F.col("pos") + 1)


@query(
    "dataset_scan",
    """
SELECT event_id, CASE WHEN length(n) < 4 THEN 'default.db' ELSE n END AS dataset
FROM (SELECT event_id, CASE WHEN c LIKE '%.db' THEN c ELSE concat(c, '.db') END AS n
      FROM (SELECT event_id, regexp_replace(CASE WHEN event_id % 9 = 0 THEN ' /#' WHEN user_id % 2 = 0
                   THEN concat(event_type, '.db') ELSE concat(' ', event_type, '/ ', CAST(user_id AS VARCHAR)) END,
                   '[^a-zA-Z0-9_.-]', '', 'g') AS c FROM events))""",
)
def dataset_scan(spark, sf):
    name = F.when(F.col("event_id") % 9 == 0, " /#").when(
        F.col("user_id") % 2 == 0, F.concat("event_type", F.lit(".db"))
    ).otherwise(F.concat(F.lit(" "), "event_type", F.lit("/ "), F.col("user_id").cast("string")))
    return _events(spark, sf).select("event_id", fn.dataset_id(name).alias("dataset"))


@query("dataset_clear", "SELECT count(*) AS rows_deleted FROM events")
def dataset_clear(spark, sf):
    log = fresh_path(spark, "log")
    records.ingest_records(_events(spark, sf), log, "events", order_col="event_id")
    return records.clear_dataset(spark, log, "events")


@query("split_scan", "SELECT id, upload_timestamp, row_data, T FROM fx_records WHERE T = 'training'", ("fx_records",))
def split_scan(spark, sf):
    return records.split_scan(_rec(spark, sf), "training")


@query(
    "matrix_sink",
    """
SELECT id, Label AS label, 'all' AS split, CAST(Spkts AS DOUBLE) AS f0, CAST(Dpkts AS DOUBLE) AS f1,
       CAST(sbytes AS DOUBLE) AS f2, CAST(dbytes AS DOUBLE) AS f3 FROM flows""",
    ("fx_raw_flows", "flows"),
)
def matrix_sink(spark, sf):
    path = fresh_path(spark, "matrix")
    assembler = VectorAssembler(inputCols=["Spkts", "Dpkts", "sbytes", "dbytes"], outputCol="features")
    matrix.write_matrix(assembler.transform(_flows(spark, sf)), path, label="Label", keep=("id",))
    return matrix.read_matrix(spark, path).select(
        "id", "label", "split", *[F.col("features")[i].cast("double").alias(f"f{i}") for i in range(4)]
    )


@query("meta_sink", "SELECT id, attack_cat FROM clean", ("fx_raw_flows", "flows", "clean"))
def meta_sink(spark, sf):
    path = fresh_path(spark, "meta")
    matrix.write_meta(_ready(spark, sf), path)
    return spark.read.csv(path, header=True, schema="id int, attack_cat string")


def _names_sql(numeric: list[str], source: str) -> str:
    parts = [f"SELECT 0 AS g, {i} AS p, '{c}' AS name" for i, c in enumerate(numeric)]
    for g, c in enumerate(schema.CATEGORICAL, 1):
        parts.append(
            f"SELECT {g}, row_number() OVER (ORDER BY v), concat('{c}_', v) "
            f"FROM (SELECT DISTINCT {c} AS v FROM {source})"
        )
    union = "\nUNION ALL ".join(parts)
    return f"SELECT CAST(row_number() OVER (ORDER BY g, p) - 1 AS INT) AS pos, name FROM ({union})"


@query("feature_names", _names_sql(_NUMBERS + schema.ENGINEERED, "ready"), _READY)
def feature_names(spark, sf):
    ready = _ready(spark, sf)
    return prep.feature_names(ready, flows.numeric_features(ready))


_models: dict[tuple, object] = {}


def _once(kind: str, spark: SparkSession, sf: str, make: Callable):
    """A fitted model serves all queries of one session."""
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _models:
        _models[key] = make()
    return _models[key]


def _record_model(spark, sf):
    train = records.split_scan(view(spark, sf, "fx_flow_records"), "training")
    return _once("records", spark, sf, lambda: forest.train_record_forest(decode_records(dealt(train))))


def _test_m(spark, sf):
    return decode_records(dealt(records.split_scan(view(spark, sf, "fx_flow_records"), "testing")))


def _prepared(spark, sf):
    return _once("matrix", spark, sf, lambda: prepare_matrix(_flows(spark, sf)))


def _flow_model(spark, sf):
    train = _prepared(spark, sf).matrix.where(F.col("split") == "train")
    return _once("flows", spark, sf, lambda: forest.train_forest(train))


def _saved(spark, sf) -> str:
    def save():
        path = fresh_path(spark, "model")
        models.save_model(_record_model(spark, sf), path)
        return path

    return _once("saved", spark, sf, save)


def _small_forest(spark, sf) -> nodes.NodeForest:
    """The small forest behind the feature stages that the training rows give."""
    train = records.split_scan(view(spark, sf, "fx_flow_records"), "training")
    front = _once("front", spark, sf, lambda: forest.record_front(decode_records(train), FOREST_FEATURES))
    return nodes.NodeForest(forest_nodes(spark), front)


@query(
    "model_save",
    "SELECT count(*) AS n, count(*) AS n_same FROM fx_flow_records WHERE T = 'testing'",
    ("fx_flow_records",),
)
def model_save(spark, sf):
    """Rows the reloaded model scores like the one that was saved."""
    m = written(_test_m(spark, sf), "records")
    before = forest.score(_record_model(spark, sf), m)
    after = forest.score(models.load_model(_saved(spark, sf)), m).withColumnRenamed("score", "again")
    same = F.count_if(F.col("score") == F.col("again"))
    return before.join(after, "id").agg(F.count("*").alias("n"), same.alias("n_same"))


@query("model_load", _PREDICTED, (*_VECTORS, ("x", "test_records"), "descent", "voted"))
def model_load(spark, sf):
    path = fresh_path(spark, "small-forest")
    models.save_model(_small_forest(spark, sf), path)
    return forest.predict(models.load_model(path), _test_m(spark, sf), ("id",))


@query(
    "model_runs",
    """
SELECT model, max(logged_at) AS logged_at, arg_max(n, logged_at) AS n_features, arg_max(a, logged_at) AS accuracy
FROM (SELECT event_type AS model, ts AS logged_at, CAST(user_id AS INT) AS n, value / 512 AS a FROM events)
GROUP BY model""",
)
def model_runs(spark, sf):
    log = fresh_path(spark, "runs")
    metric_type = schema.MODEL_RUN["metrics"].dataType
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in metric_type if f.name != "accuracy"]
    given = {
        "model": F.col("event_type"),
        "logged_at": F.col("ts").cast("timestamp"),
        "n_features": F.col("user_id").cast("int"),
        "metrics": F.struct((F.col("value") / 512).alias("accuracy"), *fields),
    }
    runs = _events(spark, sf).select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.MODEL_RUN]
    )
    models.log_run(log, runs)
    newest = models.latest_runs(spark.read.schema(schema.MODEL_RUN).parquet(log))
    return newest.select(
        "model", F.col("logged_at").cast("timestamp_ntz").alias("logged_at"), "n_features", "metrics.accuracy"
    )


@query(
    "score_source_json",
    """
SELECT label, dur, proto, rate, sbytes, CASE WHEN NOT json_valid(row_data) THEN 'request is no JSON object' END AS error
FROM wide JOIN fx_flow_records r ON wide.id = r.id""",
    _WIDE,
)
def score_source_json(spark, sf):
    path = fresh_path(spark, "requests")
    view(spark, sf, "fx_flow_records").select("row_data").write.text(path)
    data = F.col("data")
    return requests.read_score_requests(spark, path).select(
        *[data[k].alias(k) for k in ("label", "dur", "proto", "rate", "sbytes")], "error"
    )


@query(
    "score_document",
    """
SELECT CAST(to_json({'request_id': 'rf-test-001', 'model_version': 'random-forest-v1.0', 'threshold': CAST(0.55 AS DOUBLE),
                'results': list({'event_id': event_id, 'anomaly_score': score,
                                 'anomaly_flag': CASE WHEN score >= 0.55 THEN 1 ELSE 0 END} ORDER BY event_id)}) AS VARCHAR) AS document
FROM (SELECT * FROM fx_scored ORDER BY event_id LIMIT 10)""",
    ("fx_scored",),
)
def score_document(spark, sf):
    return requests.score_document(_sc(spark, sf), "rf-test-001", "random-forest-v1.0", 0.55)


# ---- projections, typing, scalar expressions -------------------------------


@query("header_normalise", "SELECT * FROM fx_raw_flows", ("fx_raw_flows",))
def header_normalise(spark, sf):
    raw = view(spark, sf, "fx_raw_flows")
    return flows.normalise_headers(raw.toDF(*[f" {c.upper()} " for c in raw.columns]))


@query("header_rename", "SELECT * FROM flows", ("fx_raw_flows", "flows"))
def header_rename(spark, sf):
    return flows.rename_headers(view(spark, sf, "fx_raw_flows"))


@query(
    "schema_validate",
    """
SELECT missing_column, (SELECT count(*) FROM flows) AS rows_affected
FROM (SELECT 'sttl' AS missing_column UNION ALL SELECT 'ackdat' UNION ALL SELECT 'Label')""",
    ("fx_raw_flows", "flows"),
)
def schema_validate(spark, sf):
    partial = _flows(spark, sf).drop("sttl", "ackdat", "Label")
    rows = partial.agg(F.count("*").alias("n")).scalar()
    return flows.missing_columns(partial).select("missing_column", rows.alias("rows_affected"))


@query("label_cast", "SELECT id, CAST(floor(Label + 0.75) AS INT) AS Label FROM flows", ("fx_raw_flows", "flows"))
def label_cast(spark, sf):
    fractional = _flows(spark, sf).select("id", (F.col("Label") + 0.75).alias("Label"))
    return flows.cast_label(fractional)


@query(
    "inf_to_null",
    "SELECT id, " + ", ".join(_clean(c) for c in _DOUBLES) + " FROM flows",
    ("fx_raw_flows", "flows"),
)
def inf_to_null(spark, sf):
    return flows.inf_to_null(_flows(spark, sf)).select("id", *_DOUBLES)


@query(
    "categorical_fill",
    "SELECT id, " + ", ".join(_clean(c) for c in _TEXTS) + " FROM flows",
    ("fx_raw_flows", "flows"),
)
def categorical_fill(spark, sf):
    return flows.fill_categoricals(_flows(spark, sf)).select("id", *_TEXTS)


def _engineered(name: str, column: Callable) -> None:
    @query(name, f"SELECT id, {name} FROM ready", _READY)
    def run(spark, sf):
        clean = flows.inf_to_null(_flows(spark, sf))
        return clean.select("id", column().alias(name))


for _name, _column in {
    "byte_ratio": fn.byte_ratio,
    "pkt_ratio": fn.pkt_ratio,
    "flow_rate": fn.flow_rate,
    "pkt_rate": fn.pkt_rate,
}.items():
    _engineered(_name, _column)


def _per_column(names: list[str], source: str, what: str = "count({c})") -> str:
    return "\nUNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS pos, '{c}' AS feature, {what.format(c=c)} AS n FROM {source}"
        for i, c in enumerate(names)
    )


def _count_columns(df: DataFrame, names: list[str]) -> DataFrame:
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(c).alias("n")) for i, c in enumerate(names)]
    return counts.select(F.inline(F.array(*rows)))


@query("select_numeric_features", _per_column(_NUMBERS + schema.ENGINEERED, "ready"), _READY)
def select_numeric_features(spark, sf):
    ready = _ready(spark, sf)
    return _count_columns(ready, flows.numeric_features(ready))


@query("drop_remainder", f"SELECT {', '.join(_NUMBERS + schema.ENGINEERED + schema.CATEGORICAL)} FROM ready", _READY)
def drop_remainder(spark, sf):
    ready = _ready(spark, sf)
    return flows.keep_features(ready, flows.numeric_features(ready))


_FEATURES = ["dur", "proto", "sbytes", "rate"]


_COERCED = ", ".join(f"{_number_sql(c)} AS {c}" for c in _FEATURES)
_FILLED = ", ".join(f"coalesce({_number_sql(c)}, 0) AS {c}" for c in _FEATURES)


@query("numeric_coerce", f"SELECT id, {_COERCED} FROM wide", _WIDE)
def numeric_coerce(spark, sf):
    wide = features.records_to_features(_flow_m(spark, sf), _FEATURES)
    return features.coerce_numeric(wide, _FEATURES).drop("label")


@query("zero_fill", f"SELECT id, {_FILLED} FROM wide", _WIDE)
def zero_fill(spark, sf):
    return features.zero_fill(numeric_coerce(spark, sf), _FEATURES)


@query(
    "records_to_features",
    """
SELECT id, label, dur, proto, rate, sbytes,
       CASE WHEN json_valid(row_data) THEN NULL ELSE 'Failed to parse row data' END AS error,
       CASE WHEN json_valid(row_data) THEN NULL ELSE row_data END AS raw
FROM wide JOIN fx_flow_records USING (id)""",
    _WIDE,
)
def records_to_features(spark, sf):
    return features.records_to_features(_flow_m(spark, sf))


@query(
    "records_to_sparse_features",
    f"""
SELECT id, k AS key, n AS value FROM (SELECT id, k, {_number_sql("v")} AS n FROM flow_entries WHERE k NOT IN ('id', 'label', 'attack_cat'))
WHERE n <> 0""",
    ("fx_flow_records", "flow_entries"),
)
def records_to_sparse_features(spark, sf):
    """The numbers in sparse vectors, by the key of their slot."""
    m = _flow_m(spark, sf)
    keys = sparse.record_dictionary(m)
    features_ = sparse.record_slots(m, keys)
    cells = features_.select("id", F.explode(F.arrays_zip("features.indices", "features.values")).alias("c"))
    return cells.join(keys, F.col("c.indices") == F.col("slot")).select("id", "key", F.col("c.values").alias("value"))


@query(
    "feature_align",
    f"SELECT id, label, {_number_sql('rate')} AS rate, CAST(0 AS DOUBLE) AS ttl, {_number_sql('dur')} AS dur FROM wide",
    _WIDE,
)
def feature_align(spark, sf):
    wide = features.records_to_features(_flow_m(spark, sf), _FEATURES)
    return features.align_features(features.coerce_numeric(wide, _FEATURES), ["rate", "ttl", "dur"])


@query(
    "common_features",
    """
SELECT CAST(p AS INT) AS pos, feature, count(v) FILTER (WHERE T = 'training') AS n_train,
       count(v) FILTER (WHERE T = 'testing') AS n_test
FROM (SELECT 0 AS p, 'dur' AS feature, T, dur AS v FROM wide JOIN fx_flow_records USING (id)
      UNION ALL SELECT 1, 'sbytes', T, sbytes FROM wide JOIN fx_flow_records USING (id))
GROUP BY p, feature""",
    _WIDE,
)
def common_features(spark, sf):
    log = view(spark, sf, "fx_flow_records")
    train = features.records_to_features(decode_records(records.split_scan(log, "training")), _FEATURES[:3])
    test = features.records_to_features(decode_records(records.split_scan(log, "testing")), ["sbytes", "rate", "dur"])
    a, b = features.common_features(train, test)
    names = features.common_feature_names(a, b)
    left = _count_columns(a, names).withColumnRenamed("n", "n_train")
    right = _count_columns(b, names).select("feature", F.col("n").alias("n_test"))
    return left.join(right, "feature").select("pos", "feature", "n_train", "n_test")


@query("type_extract", "SELECT id, raw AS type FROM typed", _TYPED)
def type_extract(spark, sf):
    return _m(spark, sf).select("id", fn.type_of("data").alias("type"))


@query("type_extract_display", "SELECT id, type FROM shown", ("fx_records", "entries", "shown"))
def type_extract_display(spark, sf):
    return _m(spark, sf).select("id", fn.display_type_of("data").alias("type"))


@query("type_normalise", "SELECT id, type FROM typed", _TYPED)
def type_normalise(spark, sf):
    return _m(spark, sf).select("id", fn.normalise_type(fn.type_of("data")).alias("type"))


@query(
    "record_flatten",
    """
SELECT id, k, v FROM (
SELECT id, k, v FROM flow_entries
UNION ALL SELECT id, 'error', 'Failed to parse row data' FROM fx_flow_records WHERE NOT json_valid(row_data)
UNION ALL SELECT id, 'raw', row_data FROM fx_flow_records WHERE NOT json_valid(row_data)
UNION ALL SELECT id, 'id', CAST(id AS VARCHAR) FROM fx_flow_records WHERE NOT json_valid(row_data)
UNION ALL SELECT id, 'T', T FROM fx_flow_records WHERE T IS NOT NULL)""",
    ("fx_flow_records", "flow_entries"),
)
def record_flatten(spark, sf):
    flat = grid.flatten_records(_flow_m(spark, sf)).select("id", F.explode_outer("row").alias("k", "v"))
    return flat.where(F.col("k") != "upload_timestamp")


_LINE_COLUMNS = ["event", "kind", "amount"]


@query(
    "csv_line_to_record",
    """
SELECT event_id, CAST(event_id AS VARCHAR) AS event, event_type AS kind,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS amount,
       CASE WHEN event_id % 6 = 0 THEN 'Invalid format. Use: event, kind, amount' END AS error
FROM events""",
)
def csv_line_to_record(spark, sf):
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    line = F.when(F.col("event_id") % 6 == 0, F.concat(event, F.lit(","), "event_type")).when(
        F.col("event_id") % 6 == 1, F.concat(event, F.lit(" ,"), "event_type", F.lit(", "), user, F.lit(",x"))
    ).otherwise(F.concat_ws(",", event, "event_type", user))
    lines = _events(spark, sf).select("event_id", "event_type", line.alias("line"))
    parsed = grid.parse_lines(lines, "line", _LINE_COLUMNS)
    data = F.col("data")
    return parsed.select(
        "event_id",
        F.coalesce(data["event"], F.col("event_id").cast("string")).alias("event"),
        F.coalesce(data["kind"], "event_type").alias("kind"),
        data["amount"].alias("amount"),
        "error",
    )


@query("label_map", "SELECT event_id, CASE y WHEN 0 THEN 'safe' WHEN 1 THEN 'unsafe' END AS label FROM fx_scored", ("fx_scored",))
def label_map(spark, sf):
    return _sc(spark, sf).select("event_id", fn.label_name("y").alias("label"))


# ---- filters ---------------------------------------------------------------


@query("valid_label", f"SELECT id, CAST(trunc({_number_sql('label')}) AS INT) AS label FROM wide WHERE {_number_sql('label')} IS NOT NULL", _WIDE)
def valid_label(spark, sf):
    return features.valid_labels(features.records_to_features(_flow_m(spark, sf), []))


@query(
    "log_search",
    """
SELECT id, kind, who FROM (
  SELECT row_number() OVER (ORDER BY event_type, event_id) AS id, event_type AS kind, concat('user-', CAST(user_id AS VARCHAR)) AS who FROM events)
WHERE contains(lower(kind), 'chas')""",
)
def log_search(spark, sf):
    """A log of a batch per kind of event, with text maps, searched for a part of a word."""
    log, events, now = fresh_path(spark, "log"), _events(spark, sf), dt.datetime.now(dt.timezone.utc)
    document = F.to_json(F.struct(F.col("event_type").alias("kind"), F.concat(F.lit("user-"), F.col("user_id")).alias("who")))
    rows = written(events.select("event_id", "event_type", document.alias("row_data")), "documents")
    for i, kind in enumerate(sorted(r[0] for r in rows.select("event_type").distinct().collect())):  # a few kinds of event
        records.write_batch(rows.where(F.col("event_type") == kind).drop("event_type"), log, "lab.db", f"b{i}", now, "event_id", map_texts=True)
    found = records.log_search(spark, log, "lab", "CHAS")
    return found.select("id", *[F.col("data")[k].alias(k) for k in ("kind", "who")])


@query(
    "any_column_search",
    """
SELECT id FROM fx_records WHERE contains(lower(CAST(id AS VARCHAR)), '77') OR contains(lower(T), '77')
UNION SELECT id FROM entries WHERE contains(lower(v), '77')
UNION SELECT id FROM fx_records WHERE contains(strftime(upload_timestamp, '%Y-%m-%d %H:%M:%S'), '77')
UNION SELECT id FROM fx_records WHERE microsecond(upload_timestamp) % 1000000 > 0 AND
  contains(rtrim(lpad(CAST(microsecond(upload_timestamp) % 1000000 AS VARCHAR), 6, '0'), '0'), '77')""",
    ("fx_records", "entries"),
)
def any_column_search(spark, sf):
    flat = grid.flatten_records(_m(spark, sf))
    return grid.search_any(flat, "77", "row").select("id")


@query(
    "positional_slice",
    "SELECT id, upload_timestamp, row_data, T FROM fx_records QUALIFY row_number() OVER (ORDER BY id) > ceil(0.8 * (SELECT count(*) FROM fx_records))",
    ("fx_records",),
)
def positional_slice(spark, sf):
    return grid.positional_slice(_rec(spark, sf), "testing")


# ---- aggregations ----------------------------------------------------------


@query(
    "record_kpis",
    """
SELECT n AS total_records, tr AS training_records, te AS testing_records,
       round(tr / n * 100, 1) AS training_percentage, round(te / n * 100, 1) AS testing_percentage
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE T = 'training') AS tr,
             count(*) FILTER (WHERE T = 'testing') AS te FROM fx_records)""",
    ("fx_records",),
)
def record_kpis(spark, sf):
    return stats.record_kpis(_rec(spark, sf))


@query("type_distribution", "SELECT type, count(*) AS n FROM typed WHERE type IS NOT NULL GROUP BY type", _TYPED)
def type_distribution(spark, sf):
    return stats.type_distribution(_rec(spark, sf))


_BY_SPLIT = """
SELECT type, count(*) AS n, count(*) FILTER (WHERE lower(T) = 'training') AS n_training,
       count(*) FILTER (WHERE lower(T) = 'testing') AS n_testing
FROM typed WHERE type IS NOT NULL GROUP BY type"""


@query("type_by_split", _BY_SPLIT, _TYPED)
def type_by_split(spark, sf):
    return stats.type_by_split(_rec(spark, sf))


@query(
    "type_percentages",
    "SELECT type, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM typed WHERE type IS NOT NULL GROUP BY type",
    _TYPED,
)
def type_percentages(spark, sf):
    return stats.type_percentages(_rec(spark, sf))


@query(
    "type_stats",
    f"""
SELECT *, round(n / sum(n) OVER () * 100, 2) AS pct,
       (SELECT count(*) FROM fx_records WHERE json_valid(row_data)) AS sample_size,
       (SELECT count(*) FROM fx_records) AS total_rows FROM ({_BY_SPLIT})""",
    _TYPED,
)
def type_stats(spark, sf):
    return stats.type_stats(_rec(spark, sf))


@query(
    "sampled_type_stats",
    """
SELECT type, count(*) AS n, count(*) FILTER (WHERE lower(T) = 'training') AS n_training,
       count(*) FILTER (WHERE lower(T) = 'testing') AS n_testing, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct,
       (SELECT count(*) FROM picked p JOIN fx_records r ON p.id = r.id WHERE json_valid(r.row_data)) AS sample_size,
       (SELECT count(*) FROM fx_records) AS total_rows, (SELECT count(*) > 900 FROM fx_records) AS sampled
FROM picked p JOIN typed t ON p.id = t.id WHERE type IS NOT NULL GROUP BY type""",
    (*_TYPED, "picked"),
)
def sampled_type_stats_(spark, sf):
    return sampled_type_stats(_rec(spark, sf), threshold=900, block=100, max_blocks=50)


@query(
    "type_stats_of_batches",
    """
SELECT type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct,
       (SELECT count(*) FROM fx_records WHERE json_valid(row_data)) AS sample_size, (SELECT count(*) FROM fx_records) AS total_rows
FROM typed WHERE type IS NOT NULL GROUP BY type""",
    _TYPED,
)
def type_stats_of_batches(spark, sf):
    """A log of three batches, two with counts of their own and one that has to be parsed."""
    log, rec = fresh_path(spark, "log"), _rec(spark, sf).select("id", "row_data")
    now = dt.datetime.now(dt.timezone.utc)
    for i in range(3):
        records.write_batch(rec.where(F.col("id") % 3 == i), log, "lab.db", f"b{i}", now, "id", count_types=i < 2)
    return stats.type_stats(records.log_type_counts(spark, log, "lab")).drop("n_training", "n_testing")


@query(
    "type_ranking",
    "SELECT row_number() OVER (ORDER BY count(*) DESC, type) AS rank, type, count(*) AS n FROM typed WHERE type IS NOT NULL GROUP BY type",
    _TYPED,
)
def type_ranking(spark, sf):
    return stats.type_ranking(_rec(spark, sf))


@query("class_balance", "SELECT Label AS label, count(*) AS n FROM fx_flows GROUP BY Label", ("fx_flows",))
def class_balance(spark, sf):
    return stats.class_balance(view(spark, sf, "fx_flows"))


@query("distinct_types_in_view", "SELECT count(DISTINCT type) AS n FROM shown", ("fx_records", "entries", "shown"))
def distinct_types_in_view(spark, sf):
    return stats.distinct_types(type_extract_display(spark, sf))


@query("confusion_matrix", "SELECT * FROM cm", _CM)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_sc(spark, sf))


@query(
    "label_confusion_matrix",
    """
SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
       count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp
FROM labels""",
)
def label_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic")


@query(
    "classification_metrics",
    """
SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
       coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score FROM cm""",
    _CM,
)
def classification_metrics(spark, sf):
    return metrics.classification_metrics(_sc(spark, sf))


@query(
    "classification_report",
    """
SELECT * FROM (
SELECT 'Safe' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM cm
UNION ALL SELECT 'Unsafe', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM cm
UNION ALL SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM cm
UNION ALL SELECT 'macro avg', (tn / (tn + fn) + tp / (tp + fp)) / 2, (tn / (tn + fp) + tp / (tp + fn)) / 2,
  (2 * tn / (2 * tn + fn + fp) + 2 * tp / (2 * tp + fp + fn)) / 2, tp + tn + fp + fn FROM cm
UNION ALL SELECT 'weighted avg', (tn / (tn + fn) * (tn + fp) + tp / (tp + fp) * (tp + fn)) / (tp + tn + fp + fn),
  (tn / (tn + fp) * (tn + fp) + tp / (tp + fn) * (tp + fn)) / (tp + tn + fp + fn),
  (2 * tn / (2 * tn + fn + fp) * (tn + fp) + 2 * tp / (2 * tp + fp + fn) * (tp + fn)) / (tp + tn + fp + fn), tp + tn + fp + fn FROM cm)""",
    _CM,
)
def classification_report(spark, sf):
    return metrics.classification_report(_sc(spark, sf))


@query(
    "threshold_sweep",
    """
SELECT t, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
FROM (SELECT t, count(*) FILTER (WHERE y = 1 AND score >= t) AS tp, count(*) FILTER (WHERE y = 0 AND score >= t) AS fp,
             count(*) FILTER (WHERE y = 1 AND score < t) AS fn
      FROM fx_scored, (SELECT 0.1e0 + i * ((0.1e0 + 0.05e0) - 0.1e0) AS t FROM range(17) AS r(i)) GROUP BY t)""",
    ("fx_scored",),
)
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(_sc(spark, sf))


_RANKED = """
FROM (SELECT score, p, n - p AS q, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS cnt,
             sum(p) OVER () AS pp, sum(n - p) OVER () AS qq
      FROM (SELECT score, sum(y) AS p, count(*) AS n FROM fx_scored GROUP BY score))"""


@query(
    "roc_auc",
    f"SELECT round(sum(CAST(p AS DOUBLE) * (qq - (cnt - tp) + q / 2.0e0)) / max(CAST(pp AS DOUBLE) * qq), 9) AS roc_auc {_RANKED}",
    ("fx_scored",),
)
def roc_auc(spark, sf):
    return metrics.ranking_metrics(_sc(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "average_precision",
    f"SELECT round(sum(CAST(p AS DOUBLE) / pp * CAST(tp AS DOUBLE) / cnt), 9) AS average_precision {_RANKED}",
    ("fx_scored",),
)
def average_precision(spark, sf):
    return metrics.ranking_metrics(_sc(spark, sf)).select(F.round("average_precision", 9).alias("average_precision"))


# ---- splits, samples, positions --------------------------------------------


@query(
    "random_split_exact",
    """
SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '42', id)), id) <= floor((SELECT count(*) FROM fx_records) * 0.3e0)
                THEN 'training' ELSE 'testing' END AS T FROM fx_records""",
    ("fx_records",),
)
def random_split_exact(spark, sf):
    return split.assign_split(_rec(spark, sf), 0.3, 42).select("id", "T")


@query(
    "stratified_split",
    """
SELECT event_id, s.y, CASE WHEN row_number() OVER (PARTITION BY s.y ORDER BY md5(concat_ws(':', '42', event_id)), event_id) <= k
                         THEN 'test' ELSE 'train' END AS split
FROM fx_scored s JOIN (
  SELECT y, c - (floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, y) <= m - sum(floor(e)) OVER () THEN 1 ELSE 0 END) AS k
  FROM (SELECT y, c, m, CAST(m * c AS DOUBLE) / n AS e
        FROM (SELECT y, count(*) AS c FROM fx_scored GROUP BY y),
             (SELECT count(*) AS n, count(*) - ceil(0.2e0 * count(*)) AS m FROM fx_scored))) a ON s.y = a.y""",
    ("fx_scored",),
)
def stratified_split(spark, sf):
    return split.stratified_split(view(spark, sf, "fx_scored"), "y", 0.2, 42, "event_id").select(
        "event_id", "y", "split"
    )


@query(
    "type_sample",
    """
SELECT id, upload_timestamp, coalesce(T, '-') AS t, type FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5(concat_ws(':', '42', id)), id) AS r FROM shown)
WHERE r <= 15 ORDER BY type, id LIMIT 100""",
    ("fx_records", "entries", "shown"),
)
def type_sample(spark, sf):
    return sample.type_sample(_m(spark, sf))


@query(
    "log_page",
    """
SELECT id, k FROM (SELECT event_id + 1 AS id, json_extract_string(props, '$.k') AS k FROM events)
ORDER BY id LIMIT 700 OFFSET (SELECT count(*) * 9 // 10 FROM events)""",
)
def log_page(spark, sf):
    """A deep page of a log of eight batches; files of one or two of them are read."""
    log, events = fresh_path(spark, "log"), _events(spark, sf).select("event_id", F.col("props").alias("row_data"))
    n, now = events.count(), dt.datetime.now(dt.timezone.utc)
    batch = F.concat(F.lit("b"), F.floor(F.col("event_id") * 8 / n).cast("string")).alias("batch")
    rows = events.select(
        (F.col("event_id") + 1).alias("id"), F.lit(now).alias("upload_timestamp"), "row_data",
        F.lit(None).cast("string").alias("T"), F.lit("lab.db").alias("dataset"), batch,
    )
    rows.write.partitionBy("dataset", "batch").parquet(log)
    found = records.log_page(spark, log, "lab", 700, n * 9 // 10).rows
    return decode_records(found).select("id", F.col("data")["k"].alias("k"))


@query(
    "block_sample",
    "SELECT id, block FROM picked",
    ("fx_records", "picked"),
)
def block_sample(spark, sf):
    return sample.block_sample(_rec(spark, sf), threshold=900, block=100, max_blocks=50).select("id", "block")


@query(
    "dense_position_text",
    "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, ts DESC, event_id) AS position FROM events",
)
def dense_position_text(spark, sf):
    """By a text that many rows share, then a falling time, then the id."""
    rows = _events(spark, sf).select("event_id", "event_type", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("falling"))
    return position.ordered_position(rows, ["event_type", "falling", "event_id"]).drop("falling")


@query(
    "offset_sample",
    """
SELECT id, block FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM fx_records) r
JOIN (SELECT CAST(i AS INT) AS block, (SELECT count(*) FROM fx_records) * i // 20 AS o FROM range(20) AS x(i)) b
ON p >= o AND p < o + 50""",
    ("fx_records",),
)
def offset_sample(spark, sf):
    return sample.offset_sample(_rec(spark, sf)).select("id", "block")


@query(
    "page",
    """
SELECT id, upload_timestamp, row_data, T, n AS total_rows, 500 AS returned_rows, 300 + 500 < n AS has_more
FROM fx_records, (SELECT count(*) AS n FROM fx_records) ORDER BY id LIMIT 500 OFFSET 300""",
    ("fx_records",),
)
def page(spark, sf):
    got = position.page(_rec(spark, sf), 500, 300)
    info = got.info.first()
    total, returned = F.lit(info["total_rows"]).cast("long"), F.lit(info["returned_rows"])
    return got.rows.withColumns(
        {"total_rows": total, "returned_rows": returned, "has_more": F.lit(info["has_more"])}
    )


@query(
    "dense_position",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM (SELECT o_orderkey * o_orderkey AS o_orderkey FROM orders)",
)
def dense_position(spark, sf):
    squared = (F.col("o_orderkey") * F.col("o_orderkey")).alias("o_orderkey")
    keys = table(spark, sf, "orders").select(squared)
    return position.dense_position(keys, "o_orderkey", bucket_rows=5_000)


# ---- feature preparation and forests ---------------------------------------

_SMALL_NUMBERS = ["dur", "Spkts", "Dpkts", "sbytes", "dbytes"] + schema.ENGINEERED
_SMALL_VIEWS = ("fx_flows", "small")
_MEDIANS = "SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in _SMALL_NUMBERS) + " FROM small"
_IMPUTED = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), m.{c}) AS {c}" for c in _SMALL_NUMBERS)
_MOMENTS = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _SMALL_NUMBERS)
_SCALED = ", ".join(f"round(({c} - a_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in _SMALL_NUMBERS)
_HOT = {"proto": ["A", "N", "R"], "state": ["F", "O"], "service": ["-", "http", "unknown"]}
_HOT_SQL = ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vs in _HOT.items() for v in vs)
_SCALED_SQL = f"""
SELECT {{columns}} FROM (SELECT s.proto, s.state, s.service, {_IMPUTED} FROM small s, ({_MEDIANS}) m) i,
     (SELECT {_MOMENTS} FROM (SELECT {_IMPUTED} FROM small s, ({_MEDIANS}) m)) x"""


def _small(spark, sf):
    return flows.prepare_flows(view(spark, sf, "fx_flows"))


def _small_written(spark, sf):
    """Statistics read their input several times; a columnar copy keeps those passes cheap."""
    return written(spread(_small(spark, sf)), "flows")


@query("median_impute", f"SELECT s.proto, {_IMPUTED} FROM small s, ({_MEDIANS}) m", _SMALL_VIEWS)
def median_impute(spark, sf):
    small = _small_written(spark, sf).select("proto", *_SMALL_NUMBERS)
    return prep.impute(small, prep.fit_medians(small, _SMALL_NUMBERS))


@query("standard_scale", _SCALED_SQL.format(columns=f"proto, {_SCALED}"), _SMALL_VIEWS)
def standard_scale(spark, sf):
    filled = median_impute(spark, sf)
    scaled = prep.scale(filled, prep.fit_scaler(filled, _SMALL_NUMBERS))
    return scaled.select("proto", *[F.round(c, 6).alias(c) for c in _SMALL_NUMBERS])


@query("one_hot", f"SELECT proto, state, service, {_HOT_SQL} FROM small", _SMALL_VIEWS)
def one_hot(spark, sf):
    small = _small(spark, sf).select(*schema.CATEGORICAL)
    return prep.one_hot(small, prep.fit_categories(small))


@query(
    "one_hot_sparse",
    """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INT) AS priority_slot,
       CAST(np + dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) AS INT) AS customer_slot, CAST(1 + np + nc AS INT) AS size
FROM orders, (SELECT count(DISTINCT o_orderpriority) AS np, count(DISTINCT o_custkey) AS nc FROM orders)""",
)
def one_hot_sparse(spark, sf):
    """A slot per priority and per customer, behind one number that is always 0."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.lit(0).alias("nothing"))
    cats = sparse.category_dictionary(orders, ["o_orderpriority", "o_custkey"])
    out = sparse.one_hot_slots(orders, ["nothing"], cats)
    slots = F.col("features.indices")
    return out.select("o_orderkey", slots[0].alias("priority_slot"), slots[1].alias("customer_slot"), F.col("features.size").alias("size"))


@query("preprocess_fit_transform", _SCALED_SQL.format(columns=f"{_SCALED}, {_HOT_SQL}"), _SMALL_VIEWS)
def preprocess_fit_transform(spark, sf):
    small = _small_written(spark, sf)
    out = prep.fit_preprocess(small, flows.numeric_features(small)).transform(small)
    values = vector_to_array("features")
    columns = [
        F.round(values[i], 6).alias(n) if n in _SMALL_NUMBERS else values[i].cast("int").alias(n)
        for i, n in enumerate(forest.vector_names(out))
    ]
    return out.select(*columns)


@query(
    "class_weights",
    "SELECT Label AS label, (SELECT count(*) FROM fx_flows) / (2.0e0 * count(*)) AS weight FROM fx_flows GROUP BY Label",
    ("fx_flows",),
)
def class_weights(spark, sf):
    return forest.class_weights(view(spark, sf, "fx_flows"), "Label")


def _quality(scored: DataFrame, trees: int, floor_f1: float, floor_auc: float) -> DataFrame:
    """scored: (y, score, pred) of rows that the model has not seen."""
    found = metrics.classification_metrics(scored).crossJoin(metrics.ranking_metrics(scored))  # one row each
    return found.select(
        F.lit(trees).alias("trees"),
        F.lit(scored.count()).alias("n_test"),
        (F.col("f1_score") >= floor_f1).alias("f1_reached"),
        (F.col("roc_auc") >= floor_auc).alias("auc_reached"),
    )


@query(
    "rf_train_weighted",
    "SELECT 200 AS trees, CAST(ceil(count(*) / 5) AS BIGINT) AS n_test, TRUE AS f1_reached, TRUE AS auc_reached FROM events",
)
def rf_train_weighted(spark, sf):
    """A fifth of the flows is held out; the floors are the published F1 and ROC-AUC less a few hundredths."""
    model = _flow_model(spark, sf)
    test = _prepared(spark, sf).matrix.where(F.col("split") == "test")
    scored = model.transform(test).select(
        F.col("label").alias("y"), vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("pred")
    )
    with small_methods(spark):
        scored = written(scored, "scored")
    return _quality(scored, model.getNumTrees, 0.93, 0.96)


@query(
    "rf_train_records",
    f"""
SELECT 100 AS trees, count(*) AS n_test, TRUE AS f1_reached, TRUE AS auc_reached
FROM wide JOIN fx_flow_records r ON r.id = wide.id WHERE r.T = 'testing' AND {_number_sql("label")} IS NOT NULL""",
    _WIDE,
)
def rf_train_records(spark, sf):
    """Trees of any depth on the training rows, judged on the others."""
    model, label = _record_model(spark, sf), fn.parse_number(F.try_element_at(F.col("data"), F.lit("label"))).cast("int")
    test = _test_m(spark, sf).withColumn("y", label)
    scored = forest.predict(model, test, ("y",)).select("y", F.col("probability_unsafe").alias("score"), F.col("prediction").alias("pred"))
    known = written(scored, "scored").where(F.col("y").isNotNull())  # filtered before, the documents would be parsed twice
    return _quality(known, forest.forest_of(model).getNumTrees, 0.93, 0.96)


@query(
    "feature_importance_topk",
    """
SELECT feature, round(importance, 9) AS importance FROM (
  SELECT f.feature, coalesce(sum(g / t), 0) / (SELECT count(*) FROM (SELECT tree FROM gained GROUP BY tree HAVING sum(g) > 0)) AS importance
  FROM (SELECT unnest(['dur', 'proto', 'sbytes', 'rate']) AS feature, unnest([0, 1, 2, 3]) AS slot) f
  LEFT JOIN (SELECT tree, feature AS slot, sum(g) AS g FROM gained GROUP BY tree, feature) s ON s.slot = f.slot
  LEFT JOIN (SELECT tree, sum(g) AS t FROM gained GROUP BY tree) a ON a.tree = s.tree GROUP BY f.feature)""",
    (*_VECTORS, ("x", "known_records"), "descent", "passed", "gained"),
)
def feature_importance_topk(spark, sf):
    """Importances of the small forest as the records with a label measure them."""
    model = _small_forest(spark, sf)
    label = fn.parse_number(F.try_element_at(F.col("data"), F.lit("label"))).cast("int").alias("label")
    rows = model.front.transform(_flow_m(spark, sf)).select("features", label)
    measured = nodes.NodeForest(nodes.measure_nodes(model.nodes, rows), model.front)
    top = forest.importance_topk(measured, FOREST_FEATURES, 10, spark)
    return top.select("feature", F.round("importance", 9).alias("importance"))


@query("rf_score", "SELECT id, score FROM voted", (*_READY, "forest", ("x", "flow_vectors"), "descent", "voted"))
def rf_score(spark, sf):
    """Prepared vectors through the small forest; a missing value goes right."""
    proto = F.when(F.col("proto") == "arp", 0.0).when(F.col("proto") == "tcp", 1.0).otherwise(2.0)
    slots = [F.col("dur"), proto, F.col("sbytes").cast("double"), F.col("rate")]
    vector = array_to_vector(F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in slots]))
    return forest.score(nodes.NodeForest(forest_nodes(spark)), _ready(spark, sf).select("id", vector.alias("features")))


@query("threshold_flag", "SELECT event_id, CASE WHEN score >= 0.55 THEN 1 ELSE 0 END AS flag FROM fx_scored", ("fx_scored",))
def threshold_flag(spark, sf):
    return _sc(spark, sf).select("event_id", fn.flag("score", 0.55).alias("flag"))


@query("predict_records", _PREDICTED, (*_VECTORS, ("x", "test_records"), "descent", "voted"))
def predict_records(spark, sf):
    return forest.predict(_small_forest(spark, sf), _test_m(spark, sf), ("id",))


@query("predict_stream", _PREDICTED, (*_VECTORS, ("x", "all_records"), "descent", "voted"))
def predict_stream_(spark, sf):
    sink = fresh_path(spark, "predictions")
    stream = spark.readStream.schema(_events(spark, sf).schema).parquet(f"{sf}/events.parque[t]")  # one file or a folder of them
    arriving = decode_records(spark.sql(_stream_view(), events=stream))
    predict_stream(
        _small_forest(spark, sf), arriving, sink, fresh_path(spark, "offsets"), ("id",)
    ).awaitTermination()
    return spark.read.parquet(sink)


def _stream_view() -> str:
    from flowsift.fixtures import FX_FLOW_RECORDS

    return FX_FLOW_RECORDS


@query(
    "evaluate_model",
    """
SELECT 'random-forest' AS model, 4 AS n_features, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision,
       tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1_score, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision
FROM cm, (SELECT sum(CAST(p AS DOUBLE) * (qq - (cnt - tp) + q / 2.0e0)) / max(CAST(pp AS DOUBLE) * qq) AS auc,
                 sum(CAST(p AS DOUBLE) / pp * CAST(tp AS DOUBLE) / cnt) AS ap
          FROM (SELECT p, n - p AS q, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS cnt,
                       sum(p) OVER () AS pp, sum(n - p) OVER () AS qq
                FROM (SELECT score, sum(y) AS p, count(*) AS n FROM sc GROUP BY score)))""",
    (*_VECTORS, ("x", "test_records"), "descent", "voted", ("sc", "voted_known"), "cm"),
)
def evaluate_model(spark, sf):
    label = fn.parse_number(F.try_element_at(F.col("data"), F.lit("label")))
    run = forest.evaluate(_small_forest(spark, sf), _test_m(spark, sf), label)
    exact = ("accuracy", "precision", "recall", "f1_score")
    summed = [F.round(f"metrics.{s}", 9).alias(s) for s in ("roc_auc", "average_precision")]
    return run.select("model", "n_features", *[f"metrics.{s}" for s in exact], *summed)


@query(
    "anomaly_rate",
    "SELECT count(*) FILTER (WHERE score >= 0.5) AS flagged, count(*) FILTER (WHERE score >= 0.5) / count(*) AS rate FROM fx_scored",
    ("fx_scored",),
)
def anomaly_rate(spark, sf):
    return metrics.anomaly_rate(_sc(spark, sf), "pred")
