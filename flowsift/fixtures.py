"""Views that give the driver tables the shape of flows, record logs and scores.

Each text runs unchanged in Spark and in an ANSI SQL engine; `{events}` and
`{lineitem}` stand for the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsift.operators.nodes import NODES
from flowsift.schema import FLOW_TYPES, RENAMES

FX_RECORDS = """
SELECT event_id + 1 AS id,
       ts AS upload_timestamp,
       CASE event_id % 10
         WHEN 0 THEN '{{bad json'
         WHEN 1 THEN concat('{{"Category":"', event_type, '","label":"ignored"}}')
         WHEN 2 THEN concat('{{"type":null,"Label":"', event_type, '"}}')
         WHEN 3 THEN '{{"type":" NaN "}}'
         WHEN 4 THEN concat('{{"user":', CAST(user_id AS VARCHAR(20)), '}}')
         WHEN 5 THEN concat('{{"TYPE":"  ', event_type, ' "}}')
         ELSE concat('{{"type":"', event_type, '","label":"z"}}')
       END AS row_data,
       CASE WHEN event_id % 10 = 9 THEN NULL
            WHEN event_id % 3 = 0 THEN 'training' ELSE 'testing' END AS T
FROM {events}
"""

FX_FLOWS = """
SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS dur,
       l_returnflag AS proto, l_linestatus AS state,
       CASE WHEN l_tax = 0 THEN NULL WHEN l_tax < 0.04 THEN '-' ELSE 'http' END AS service,
       l_quantity AS Spkts, CAST(l_linenumber AS DOUBLE) AS Dpkts,
       l_extendedprice AS sbytes, l_quantity * l_tax * 100 AS dbytes,
       CASE WHEN l_returnflag = 'R' AND l_extendedprice > 20000 THEN 1
            WHEN l_extendedprice > 80000 THEN 1 ELSE 0 END AS Label
FROM {lineitem}
"""

FX_SCORED = """
SELECT event_id,
       CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y,
       least(CAST(1 AS DOUBLE),
             CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)
             + CASE WHEN event_type = 'error' THEN CAST(0.3 AS DOUBLE)
                    ELSE CAST(0 AS DOUBLE) END) AS score
FROM {events}
"""

# The record log a client would upload: one flow per document, all values text,
# with a non-numeric feature, an unparseable number and a missing key now and then.
FX_FLOW_RECORDS = """
SELECT event_id + 1 AS id,
       ts AS upload_timestamp,
       CASE WHEN event_id % 41 = 0 THEN '{{bad json' ELSE
         concat('{{"id":"', CAST(event_id AS VARCHAR(20)),
                '","dur":"', CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(event_id % 97 AS VARCHAR(20)) END,
                '","proto":"', CASE WHEN user_id % 3 = 0 THEN 'udp' ELSE 'tcp' END,
                CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('","sbytes":"', CAST(user_id * 31 AS VARCHAR(20))) END,
                '","rate":" ', CAST(CAST(floor(value) AS INT) AS VARCHAR(20)), ' ","attack_cat":"', event_type,
                '","label":"', CASE WHEN event_id % 29 = 0 THEN 'unknown'
                                    WHEN value > 60 OR (user_id % 3 = 0 AND value > 20) THEN '1'
                                    ELSE '0' END, '"}}') END AS row_data,
       CASE WHEN event_id % 10 < 3 THEN 'training' ELSE 'testing' END AS T
FROM {events}
"""


def _raw_flow_sql() -> str:
    special = {
        "id": "CAST(event_id AS INT)",
        "dur": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 8 END",
        "proto": "CASE WHEN user_id % 3 = 0 THEN 'udp' WHEN user_id % 3 = 1 THEN 'tcp' ELSE 'arp' END",
        "service": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN '-' ELSE 'http' END",
        "state": "CASE WHEN event_id % 4 = 0 THEN 'INT' ELSE 'FIN' END",
        "rate": "CASE WHEN event_id % 101 = 0 THEN CAST('Infinity' AS DOUBLE) "
                "WHEN event_id % 103 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value END",
        "attack_cat": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END",
        "label": "CASE WHEN value > 60 OR (user_id % 3 = 0 AND value > 20) THEN 1 ELSE 0 END",
    }
    raw_name = {new: old for old, new in RENAMES.items()}
    columns = []
    for i, (name, kind) in enumerate(FLOW_TYPES.items()):
        raw = raw_name.get(name, name)
        if raw in special:
            text = special[raw]
        elif kind == "double":
            text = f"value * {i} / 16"
        else:
            text = f"CAST((event_id * {7 * i + 1} + user_id) % {50 + 3 * i} AS {kind.upper()})"
        columns.append(f"{text} AS {raw}")
    return "SELECT " + ",\n       ".join(columns) + "\nFROM {events}\n"


FX_RAW_FLOWS = _raw_flow_sql()

VIEWS = {
    "fx_records": FX_RECORDS,
    "fx_flows": FX_FLOWS,
    "fx_scored": FX_SCORED,
    "fx_flow_records": FX_FLOW_RECORDS,
    "fx_raw_flows": FX_RAW_FLOWS,
}
_SOURCE = {"fx_flows": "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _SOURCE.get(name, "events")
    return spark.sql(VIEWS[name], **{source: table(spark, sf_dir, source)})


def view_sql(name: str) -> str:
    """The view's text over tables named `events` and `lineitem`."""
    return VIEWS[name].format(events="events", lineitem="lineitem")


#: A small forest over (dur, place of proto in the alphabet, sbytes, rate): tree, node, feature,
#: threshold, categories that go left, left, right, share of class 1. All shares are
#: sums of powers of two, so that no engine rounds.
FOREST = [
    (0, 0, 3, 60.0, None, 1, 2, 0.5),
    (0, 1, 1, None, [0.0], 3, 4, 0.375),
    (0, 2, None, None, None, None, None, 0.9375),
    (0, 3, None, None, None, None, None, 0.0625),
    (0, 4, 3, 20.0, None, 5, 6, 0.5),
    (0, 5, None, None, None, None, None, 0.125),
    (0, 6, None, None, None, None, None, 0.875),
    (1, 0, 1, None, [0.0], 1, 2, 0.5),
    (1, 1, 3, 60.0, None, 3, 4, 0.375),
    (1, 2, 3, 20.0, None, 5, 6, 0.5),
    (1, 3, None, None, None, None, None, 0.03125),
    (1, 4, None, None, None, None, None, 0.96875),
    (1, 5, None, None, None, None, None, 0.125),
    (1, 6, None, None, None, None, None, 0.75),
    (2, 0, 0, 48.0, None, 1, 2, 0.4375),
    (2, 1, 2, 1500.0, None, 3, 4, 0.5),
    (2, 2, None, None, None, None, None, 0.375),
    (2, 3, 3, 40.0, None, 5, 6, 0.5),
    (2, 4, None, None, None, None, None, 0.5),
    (2, 5, None, None, None, None, None, 0.25),
    (2, 6, None, None, None, None, None, 0.625),
    (3, 0, 2, 0.0, None, 1, 2, 0.5),
    (3, 1, None, None, None, None, None, 0.4375),
    (3, 2, 3, 55.5, None, 3, 4, 0.5),
    (3, 3, None, None, None, None, None, 0.1875),
    (3, 4, None, None, None, None, None, 0.84375),
]
FOREST_FEATURES = ["dur", "proto", "sbytes", "rate"]


def forest_nodes(spark: SparkSession) -> DataFrame:
    """The small forest as a node table; weights and gains are not measured."""
    rows = [(t, n, f, cut, cats, left, right, [1 - p, p], None, None) for t, n, f, cut, cats, left, right, p in FOREST]
    return spark.createDataFrame(rows, NODES)


def forest_sql() -> str:
    """The same as a list of SQL rows (tree, node, feature, threshold, categories, lft, rgt, p)."""
    text = lambda v: "NULL" if v is None else str(v)
    values = ",\n".join(f"({', '.join(map(text, row))})" for row in FOREST)
    return f"SELECT * FROM (VALUES {values}) AS v(tree, node, feature, threshold, categories, lft, rgt, p)"
