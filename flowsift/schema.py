"""Names and types of the flow table and the record log."""

from __future__ import annotations

from pyspark.sql import types as T

# The flow-table column names, their types and their roles.
FLOW_TYPES = {
    "id": "int",
    "dur": "double",
    "proto": "string",
    "service": "string",
    "state": "string",
    "Spkts": "int",
    "Dpkts": "int",
    "sbytes": "bigint",
    "dbytes": "bigint",
    "rate": "double",
    "sttl": "int",
    "dttl": "int",
    "Sload": "double",
    "Dload": "double",
    "sloss": "int",
    "dloss": "int",
    "Sintpkt": "double",
    "Dintpkt": "double",
    "Sjit": "double",
    "Djit": "double",
    "swin": "int",
    "stcpb": "bigint",
    "dtcpb": "bigint",
    "dwin": "int",
    "tcprtt": "double",
    "synack": "double",
    "ackdat": "double",
    "smeansz": "int",
    "dmeansz": "int",
    "trans_depth": "int",
    "res_bdy_len": "bigint",
    "ct_srv_src": "int",
    "ct_state_ttl": "int",
    "ct_dst_ltm": "int",
    "ct_src_dport_ltm": "int",
    "ct_dst_sport_ltm": "int",
    "ct_dst_src_ltm": "int",
    "is_ftp_login": "int",
    "ct_ftp_cmd": "int",
    "ct_flw_http_mthd": "int",
    "ct_src_ltm": "int",
    "ct_srv_dst": "int",
    "is_sm_ips_ports": "int",
    "attack_cat": "string",
    "Label": "int",
}

# Raw header -> internal name.
RENAMES = {
    "label": "Label",
    "spkts": "Spkts",
    "dpkts": "Dpkts",
    "sload": "Sload",
    "dload": "Dload",
    "sjit": "Sjit",
    "djit": "Djit",
    "sinpkt": "Sintpkt",
    "dinpkt": "Dintpkt",
    "smean": "smeansz",
    "dmean": "dmeansz",
    "response_body_len": "res_bdy_len",
}

REQUIRED = list(FLOW_TYPES)
NOT_FEATURES = ["id", "attack_cat", "Label"]
CATEGORICAL = ["proto", "state", "service"]
ENGINEERED = ["byte_ratio", "pkt_ratio", "flow_rate", "pkt_rate"]
META = ["id", "attack_cat"]

# Label names, split names, keys that never become record features.
LABEL_NAMES = {0: "safe", 1: "unsafe"}
TRAINING, TESTING = "training", "testing"
RECORD_NOT_FEATURES = ["label", "id", "attack_cat"]

# Texts the reader treats as a missing cell of a flow CSV.
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

RECORDS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("upload_timestamp", T.TimestampType()),
        T.StructField("row_data", T.StringType()),
        T.StructField("T", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("batch", T.StringType()),
    ]
)

MODEL_RUN = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("logged_at", T.TimestampType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "metrics",
            T.StructType(
                [
                    T.StructField("accuracy", T.DoubleType()),
                    T.StructField("precision", T.DoubleType()),
                    T.StructField("recall", T.DoubleType()),
                    T.StructField("f1_score", T.DoubleType()),
                    T.StructField("roc_auc", T.DoubleType()),
                    T.StructField("average_precision", T.DoubleType()),
                    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
                    T.StructField(
                        "feature_importance",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("feature", T.StringType()),
                                    T.StructField("importance", T.DoubleType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
        T.StructField("label_mapping", T.MapType(T.StringType(), T.StringType())),
    ]
)
