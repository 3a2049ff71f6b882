import math
import random
import statistics

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowsift import functions as fn
from flowsift import schema
from flowsift.fixtures import view
from flowsift.operators import features, flows, forest, prep
from flowsift.sources.flows import read_flows


def test_schema_has_the_45_required_columns():
    assert len(schema.REQUIRED) == 45
    numeric = [c for c, t in schema.FLOW_TYPES.items() if t != "string" and c not in schema.NOT_FEATURES]
    assert len(numeric) == 39  # with 4 engineered and 151 one-hot columns: 194


@pytest.mark.parametrize(
    "text, number",
    [
        ("1", 1.0), (" -2.5e3\t", -2500.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("1f", None), ("0x1", None),
        ("", None), ("nan", None), ("1_0", None), ("inf", math.inf), ("-Infinity", -math.inf), ("abc", None),
    ],
)
def test_parse_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "v string").select(fn.parse_number("v")).first()[0] == number


def test_ratios_of_zero_and_missing(spark):
    df = spark.createDataFrame(
        [(10, 0, 0.0), (10, -1, 1.0), (None, 1, 1.0), (2**62, 2**62, 0.5)], "sbytes long, dbytes long, dur double"
    )
    assert [r[0] for r in df.select(fn.byte_ratio()).collect()] == [10.0, None, None, 2.0**62 / (2.0**62 + 1)]
    rates = [r[0] for r in df.select(fn.flow_rate()).collect()]
    assert rates[0] == 10 / 1e-6 and rates[2] is None and rates[3] == 2.0**63 / (0.5 + 1e-6)


def test_flow_csv_missing_cells_and_dash(spark, tmp_path):
    names = [next((o for o, n in schema.RENAMES.items() if n == c), c) for c in schema.REQUIRED]
    values = {c: "1" for c in schema.REQUIRED} | {"service": "-", "proto": "NA", "dur": "inf", "stcpb": "9007199254740993"}
    row = [values[c] for c in schema.REQUIRED]
    source = tmp_path / "flows.csv"
    source.write_text(",".join(f" {n.upper()} " for n in names) + ",extra\n" + ",".join(row) + ",2.5\n")
    df = read_flows(spark, str(source))
    got = df.first()
    assert (got["service"], got["proto"], got["dur"], got["stcpb"]) == ("-", None, math.inf, 9007199254740993)
    assert "extra" in flows.numeric_features(df) and got["extra"] == 2.5
    cleaned = flows.prepare_flows(df).first()
    assert cleaned["proto"] == "unknown" and cleaned["dur"] is None and cleaned["flow_rate"] is None
    source.write_text("id,label\n1,0\n")
    with pytest.raises(ValueError, match="dur"):
        read_flows(spark, str(source))
    source.write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_flows(spark, str(source))


def test_null_label_fails(spark):
    df = spark.createDataFrame([(1.9,), (None,)], "Label double")
    assert flows.cast_label(df.where("Label is not null")).first()["Label"] == 1
    with pytest.raises(Exception, match="Label is null"):
        flows.cast_label(df).collect()


@pytest.mark.parametrize("n", [1, 2, 501, 4000])
def test_exact_medians_by_narrowing(spark, n):
    rng = random.Random(n)
    rows = [
        (
            rng.lognormvariate(0, 4),
            float(rng.choice([1, 1, 1, 7])),
            None if i % 3 == 0 else float(i),
            None,
            float(i % 2) * 1e12,
        )
        for i in range(n)
    ]
    cols = ["heavy", "hot", "gaps", "void", "two"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(4)
    want = {c: statistics.median(v) if (v := [r[i] for r in rows if r[i] is not None]) else None for i, c in enumerate(cols)}
    assert prep.exact_medians(df, cols, small=3) == want
    assert prep.exact_medians(df, cols) == want


def test_scaled_columns_have_population_moments(spark):
    df = spark.createDataFrame([(float(i * i), 5.0) for i in range(50)], "a double, flat double")
    scaled = prep.scale(df, prep.fit_scaler(df, ["a", "flat"]))
    row = scaled.agg(F.avg("a"), F.stddev_pop("a"), F.max("flat"), F.min("flat")).first()
    assert abs(row[0]) < 1e-12 and abs(row[1] - 1) < 1e-12 and row[2] == row[3] == 0


def test_impute_drops_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    got = prep.impute(df, prep.fit_medians(df, ["a", "b"]))
    assert got.columns == ["a"] and sorted(r["a"] for r in got.collect()) == [1.0, 2.0, 3.0]


def test_preprocessing_of_unseen_and_missing_values(spark, tmp_path):
    fit = spark.createDataFrame(
        [(1.0, "tcp", "FIN", "-", 0), (3.0, "udp", None, "http", 1), (None, "tcp", "INT", "dns", 0)],
        "x double, proto string, state string, service string, Label int",
    )
    model = prep.fit_preprocess(fit, ["x"])
    model.write().save(str(tmp_path / "model"))
    model = type(model).load(str(tmp_path / "model"))
    new = spark.createDataFrame(
        [(None, "icmp", None, "dns")], "x double, proto string, state string, service string"
    )
    out = model.transform(new)
    assert out.columns == [*new.columns, "features"]
    names = forest.vector_names(out)
    assert names == [
        "x", "proto_tcp", "proto_udp", "state_FIN", "state_INT", "state_unknown", "service_-", "service_dns", "service_http",
    ]
    got = dict(zip(names, out.select(vector_to_array("features")).first()[0]))
    assert {n for n, v in got.items() if v} == {"state_unknown", "service_dns"}
    assert [r["name"] for r in prep.feature_names(fit, ["x"]).orderBy("pos").collect()] == names
    hot = prep.one_hot(new, prep.fit_categories(fit)).first()
    assert hot["proto_tcp"] == hot["proto_udp"] == 0 and hot["state_unknown"] == 1


def test_fit_on_training_ignores_test_rows(spark):
    df = spark.createDataFrame(
        [(1.0, "a", "train"), (3.0, "a", "train"), (1000.0, "b", "test")], "x double, proto string, split string"
    )
    names = lambda fit_on: forest.vector_names(
        prep.fit_preprocess(df, ["x"], ["proto"], fit_on=fit_on).transform(df)
    )
    assert names("training") == ["x", "proto_a"] and names("all") == ["x", "proto_a", "proto_b"]


def test_alignment_and_common_features(spark):
    train = spark.createDataFrame([(1, 0, 1.0, 2.0)], "id int, label int, a double, b double")
    test = spark.createDataFrame([(1, 0, 5.0, 6.0)], "id int, label int, c double, a double")
    row = features.align_features(test, ["a", "b"]).first()
    assert row.asDict() == {"id": 1, "label": 0, "a": 6.0, "b": 0.0}
    left, right = features.common_features(train, test)
    assert left.columns == right.columns == ["id", "label", "a"]


def test_labels_are_cut_and_invalid_ones_dropped(spark):
    df = spark.createDataFrame([("1.9",), ("x",), (None,), (" 0 ",)], "label string")
    assert sorted(r["label"] for r in features.valid_labels(df).collect()) == [0, 1]


def test_scan_reads_only_wanted_columns(spark, sf):
    plan = flows.keep_features(flows.add_features(view(spark, sf, "fx_flows")), ["byte_ratio"], [])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_tax:double>" in text


def test_whole_number_columns_keep_other_numbers(spark, tmp_path):
    names = {new: old for old, new in schema.RENAMES.items()}
    header = [names.get(c, c) for c in schema.FLOW_TYPES]
    row = {names.get(c, c): "1" for c in schema.FLOW_TYPES} | {"label": "0"}
    rows = [row, row | {"sttl": "3.5", "spkts": "99999999999"}, row | {"dttl": "x", "sttl": ""}]
    path = tmp_path / "f.csv"
    path.write_text("\n".join(",".join(r) for r in [header, *[[x[h] for h in header] for x in rows]]))
    df = read_flows(spark, str(path))
    assert dict(df.dtypes)["sttl"] == dict(df.dtypes)["Spkts"] == "double" and dict(df.dtypes)["dttl"] == "int"
    assert {(r.sttl, r.Spkts, r.dttl) for r in df.collect()} == {(1.0, 1.0, 1), (3.5, 99999999999.0, 1), (None, 1.0, None)}


def test_a_deeper_forest_than_possible_is_refused(spark):
    with pytest.raises(ValueError, match="at most 30"):
        forest._forest(1, 31, 1)
