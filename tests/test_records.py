import datetime as dt
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from flowsift import functions as fn
from flowsift.operators import grid, stats
from flowsift.operators.features import column_names, records_to_features
from flowsift.session import fresh_path
from flowsift.sources import records
from flowsift.sources.decode import decode_records
from flowsift.sources.requests import read_score_requests
from flowsift.streaming import ingest_stream

NOW = dt.datetime(2025, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)


def log_of(spark, texts, t=None):
    rows = [(i + 1, NOW, text, (t or [None] * len(texts))[i]) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, upload_timestamp timestamp, row_data string, T string")


def test_decode_keeps_or_skips_broken_rows(spark):
    rec = log_of(spark, ['{"b":1,"a":null}', "{bad", '{"x":1} tail', "{'q':1}", '{"k":1,"j":2,"k":3}', "{}"])
    kept = {r["id"]: r["data"] for r in decode_records(rec).collect()}
    keys = {r["id"]: r["k"] for r in decode_records(rec).select("id", F.map_keys("data").alias("k")).collect()}
    assert kept[1] == {"b": "1", "a": None} and keys[1] == ["b", "a"]
    for i, raw in ((2, "{bad"), (3, '{"x":1} tail'), (4, "{'q':1}")):
        assert kept[i] == {"error": "Failed to parse row data", "raw": raw}
    assert kept[5] == {"k": "3", "j": "2"} and keys[5] == ["k", "j"]
    assert {r["id"] for r in decode_records(rec, "skip").collect()} == {1, 5, 6}


@pytest.mark.parametrize(
    "document, expected",
    [
        ('{"label":"a","TYPE":"b"}', "b"),
        ('{"Type":null,"class":"c","label":"d"}', "c"),
        ('{"label":null,"category":"x"}', None),
        ('{"type":"","label":"z"}', ""),
        ('{"other":"x"}', None),
        ('{"type":5}', "5"),
    ],
)
def test_type_rule(spark, document, expected):
    m = decode_records(log_of(spark, [document]))
    assert m.select(fn.type_of("data")).first()[0] == expected


@pytest.mark.parametrize(
    "document, expected",
    [
        ('{"label":"l","type":" t "}', "t"),
        ('{"TYPE":"-","label":"l"}', "l"),
        ('{"type":"   ","label":"l"}', "-"),
        ('{"type":"","label":"l"}', "-"),
        ('{"type":null,"label":"l"}', "null"),
        ('{"ATTACK_CAT":"dos"}', "dos"),
        ('{"n":"1"}', "-"),
        ("{bad", "-"),
    ],
)
def test_display_type_rule(spark, document, expected):
    m = decode_records(log_of(spark, [document]))
    assert m.select(fn.display_type_of("data")).first()[0] == expected


def test_normalise_type(spark):
    values = [" a\t", "NaN", " NULL ", "undefined", "None", "", " b\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(fn.normalise_type("v")).collect()]
    assert got == ["a", None, None, None, None, None, "b"]


@pytest.mark.parametrize(
    "name, expected",
    [
        (None, "default.db"),
        ("", "default.db"),
        ("/#", "default.db"),
        ("lab 1", "lab1.db"),
        ("x.db", "x.db"),
        ("../up", "..up.db"),
    ],
)
def test_dataset_names(spark, name, expected):
    assert records.dataset_name(spark, name) == expected


def test_log_life_cycle(spark, tmp_path):
    table = str(tmp_path / "log")
    source = tmp_path / "in.csv"
    source.write_text('a,type\n1,"x, ""y"""\n,z\n3\n4,w,surplus\n')
    assert records.ingest_csv(spark, str(source), table, "lab", ts=NOW) == 4
    rows = records.dataset_scan(spark, table, "lab").orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4]
    assert [r["row_data"] for r in rows] == [
        '{"a":"1","type":"x, \\"y\\""}', '{"a":"","type":"z"}', '{"a":"3","type":null}',
        '{"a":"4","type":"w","null":["surplus"]}',
    ]
    assert {r["upload_timestamp"] for r in rows} == {NOW.replace(tzinfo=None)}

    more = spark.createDataFrame([('{"type":7}',)], "row_data string")
    assert records.append_records(more, table, "lab") == 1
    assert records.append_records(more, table, "other") == 1
    assert records.dataset_scan(spark, table, "lab").agg(F.max("id")).first()[0] == 5
    assert records.dataset_scan(spark, table, "other").first()["id"] == 1

    with pytest.raises(ValueError):
        records.require_split(records.dataset_scan(spark, table, "lab"))
    labelled = records.relabel_dataset(spark, table, "lab", seed=1)
    assert labelled.groupBy("T").count().collect().__len__() == 2
    assert records.split_scan(labelled, "training").count() == 1
    assert labelled.count() == 5

    assert records.clear_dataset(spark, table, "lab").first()["rows_deleted"] == 5
    assert records.clear_dataset(spark, table, "lab").first()["rows_deleted"] == 0
    assert records.dataset_scan(spark, table, "other").count() == 1
    assert records.append_records(more, table, "lab") == 1
    assert records.dataset_scan(spark, table, "lab").first()["id"] == 1


def test_repeated_batch_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "log")
    df = spark.range(10).select(F.col("id").alias("n"))
    for _ in range(2):
        records.ingest_records(df, table, "lab", order_col="n", batch="upload-1")
    assert sorted(r["id"] for r in records.dataset_scan(spark, table, "lab").collect()) == list(range(1, 11))


def test_bad_uploads_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="CSV"):
        records.read_record_csv(spark, str(tmp_path / "in.txt"))
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError, match="empty"):
        records.read_record_csv(spark, str(empty))
    latin = tmp_path / "latin.csv"
    latin.write_bytes("a\nü\n".encode("latin-1"))
    with pytest.raises(ValueError, match="UTF-8"):
        records.read_record_csv(spark, str(latin))
    for text in ("{}", "{bad", "[1]"):
        with pytest.raises(ValueError):
            records.append_records(spark.createDataFrame([(text,)], "row_data string"), str(tmp_path / "t"), "x")


def test_ids_follow_file_order(spark, tmp_path):
    source = tmp_path / "big.csv"
    source.write_text("n\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records.ingest_csv(spark, str(source), str(tmp_path / "log"), "lab")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    log = decode_records(records.dataset_scan(spark, str(tmp_path / "log"), "lab"))
    wrong = log.where(F.col("data")["n"].cast("long") + 1 != F.col("id")).count()
    assert wrong == 0 and log.count() == 5000


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "arriving"
    spark.range(100).selectExpr("cast(id as string) n", "concat('t', id % 3) type").repartition(4).write.csv(
        str(source), header=True
    )
    table, offsets = str(tmp_path / "log"), str(tmp_path / "offsets")
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(
            spark, str(source), table, offsets, "s", schema="n string, type string", max_files=3, order_col="n"
        ).awaitTermination()
    log = records.dataset_scan(spark, table, "s")
    assert sorted(r["id"] for r in log.collect()) == list(range(1, 101))
    counts = {r["type"]: r["n"] for r in stats.type_distribution(log).collect()}
    assert counts == {"t0": 34, "t1": 33, "t2": 33}

    jsons = tmp_path / "json"
    spark.range(20).selectExpr("concat('{\"v\":', id, '}') v").union(spark.sql("select '{bad'")).write.text(str(jsons))
    ingest_stream(spark, str(jsons), table, str(tmp_path / "o2"), "j", fmt="json").awaitTermination()
    assert records.dataset_scan(spark, table, "j").count() == 20


def test_stream_keeps_rejects_in_the_same_commit(spark, tmp_path):
    source, table, offsets = tmp_path / "json", str(tmp_path / "log"), str(tmp_path / "offsets")
    source.mkdir()

    def run():
        query = ingest_stream(spark, str(source), table, offsets, "j", fmt="json")
        query.awaitTermination()
        return [p["observedMetrics"]["arrived"] for p in map(dict_of, query.recentProgress) if "arrived" in p["observedMetrics"]]

    (source / "a.json").write_text('{"v":1}\n{bad\n\n  \n{}\n[1]\n"text"\n{"v":2} x\n{"v":3}\n')
    first = [m for m in run() if m["lines"]]
    assert [(m["lines"], m["stored"], m["rejected"]) for m in first] == [(7, 2, 5)]
    rejects = {r.line: r.reason for r in records.read_rejects(spark, table, "j").collect()}
    assert rejects == {
        "{bad": "no JSON object", "{}": "empty object", "[1]": "no JSON object", '"text"': "no JSON object",
        '{"v":2} x': "no JSON object",
    }
    assert sorted(r.id for r in records.dataset_scan(spark, table, "j").collect()) == [1, 2]

    (source / "b.json").write_text("nothing\n")
    run()
    last = max(os.listdir(offsets + "/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    for name in (last, f".{last}.crc"):  # the batch was written, its commit was not: it is run again
        if os.path.exists(f"{offsets}/commits/{name}"):
            os.replace(f"{offsets}/commits/{name}", str(tmp_path / f"lost{name}"))
    run()
    assert records.read_rejects(spark, table, "j").count() == 6
    assert records.dataset_scan(spark, table, "j").count() == 2
    assert records.clear_dataset(spark, table, "j").first()[0] == 2
    assert records.read_rejects(spark, table, "j").count() == 0


def dict_of(progress):
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def test_type_counts_of_batches(spark, tmp_path):
    table = str(tmp_path / "log")
    texts = ['{"type":"a"}', '{"type":"a"}', '{"TYPE":" b "}', '{"type":"nan"}', "{bad", '{"x":1}', '{"type":"c \\"q\\""}']

    def add(batch, rows, **more):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "n long, row_data string")
        records.write_batch(df, table, "lab.db", batch, NOW, "n", **more)

    def check():
        whole = stats.type_stats(records.dataset_scan(spark, table, "lab")).orderBy("type").collect()
        counts = records.log_type_counts(spark, table, "lab")
        assert stats.type_stats(counts).orderBy("type").collect() == whole
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        return whole, {part for part in ("lab.db", "lab.db.types") if f"= {part})" in plan}  # partitions that are scanned

    add("one", texts)
    add("old", texts[:3], count_types=False)
    whole, read = check()
    assert {(r["type"], r["n"]) for r in whole} == {("a", 4), ("b", 2), ("c \"q\"", 1)} and read == {"lab.db", "lab.db.types"}
    records.relabel_dataset(spark, table, "lab", seed=1)
    whole, read = check()
    assert sum(r["n_training"] + r["n_testing"] for r in whole) == 7 and read == {"lab.db.types"}  # no row is parsed
    add("one", texts[:2])  # a repeated batch replaces rows and counts
    whole, read = check()
    assert {(r["type"], r["n"]) for r in whole} == {("a", 4), ("b", 1)} and read == {"lab.db.types"}
    assert records.clear_dataset(spark, table, "lab").first()[0] == 5
    assert records.log_type_counts(spark, table, "lab").count() == 0
    add("new", texts[2:3])
    assert [(r["type"], r["n"]) for r in check()[0]] == [("b", 1)]


def test_deep_pages_of_a_gapped_log(spark, tmp_path):
    table = str(tmp_path / "log")
    ids = [i * 7 for i in range(300)] + [10**6 + i for i in range(200)] + [10**9 + i * i for i in range(300)]
    rows = [(i, NOW, f'{{"v":{i}}}', None, "lab.db", f"b{n // 100}") for n, i in enumerate(ids)]
    rows += [(3, NOW, "{}", None, "lab.db", "b9"), (10**6 + 500, NOW, "{}", None, "lab.db", "b9")]  # overlaps several batches
    spark.createDataFrame(rows, records.RECORDS).write.partitionBy("dataset", "batch").parquet(table)
    order = sorted(r[0] for r in rows)
    for offset, limit in ((0, 10), (95, 230), (500, 100), (640, 70), (795, 50), (5000, 10), (-3, 0)):
        found = records.log_page(spark, table, "lab", limit, offset, default=5)
        want = order[max(offset, 0) :][: limit or 5]
        assert [r["id"] for r in found.rows.collect()] == want
        info = found.info.first()
        assert (info["total_rows"], info["returned_rows"]) == (802, len(want))
        assert info["has_more"] == (max(offset, 0) + len(want) < 802)
    plan = records.log_page(spark, table, "lab", 10, 790).rows._jdf.queryExecution().optimizedPlan().toString()
    assert "b7" in plan and "b6" not in plan

    more = spark.createDataFrame([(i, "{}") for i in range(50)], "n long, row_data string")
    assert records.write_batch(more, table, "lab.db", "next", NOW, "n") == 50
    index = {r["batch"]: (r["low"], r["high"], r["n"]) for r in records.log_index(spark, table, "lab").collect()}
    top = max(order)
    assert index["next"] == (top + 1, top + 50, 50) and len(index) == 10
    assert [r["id"] for r in records.log_page(spark, table, "lab", 3, 849).rows.collect()] == [top + 48, top + 49, top + 50]
    assert records.log_page(spark, table, "none", 3, 0).rows.count() == 0


def test_search_reads_only_batches_that_can_hold_the_text(spark, tmp_path):
    table, rng = str(tmp_path / "log"), random.Random(3)
    words = ["alpha", "Bravo", "chÄrlie", "delta", "écho", "fox trot", "漢字文", "x", "", "a.b*c"]
    for i in range(6):
        texts = [json.dumps({"k": rng.choice(words[i : i + 4]), "n": str(rng.randrange(50)), "z": None}, ensure_ascii=False) for _ in range(30)]
        df = spark.createDataFrame([(n, t) for n, t in enumerate([*texts, "{bad json", "{}"])], "n long, row_data string")
        records.write_batch(df, table, "lab.db", f"b{i}", NOW, "n", map_texts=i != 5)
    rows = decode_records(records.dataset_scan(spark, table, "lab"))
    read = {}
    for q in ("ALPHA", "lph", "chär", "écho", "x tr", "漢字文", "b*c", "ed to par", "zzz", "4", "", "no such text"):
        found = records.log_search(spark, table, "lab", q)
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in grid.search_any(rows, q).collect()), q
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        read[q] = {b for b in (f"b{i}" for i in range(6)) if re.search(rf"\b{b}\b", plan)}
    assert read["ALPHA"] == {"b0", "b5"} and read["no such text"] == {"b5"} and not read["4"]  # b5 has no maps
    assert read["ed to par"] == {f"b{i}" for i in range(6)}  # text of broken rows


def test_type_statistics_edges(spark):
    texts = ['{"type":"a"}', '{"type":"a"}', '{"TYPE":" b "}', '{"type":"nan"}', "{bad", '{"x":1}']
    rec = log_of(spark, texts, ["training", "TESTING", None, "training", "testing", "testing"])
    got = {r["type"]: r.asDict() for r in stats.type_stats(rec).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["n"], got["a"]["n_training"], got["a"]["n_testing"]) == (2, 1, 1)
    assert (got["b"]["n"], got["b"]["n_training"], got["b"]["n_testing"]) == (1, 0, 0)
    assert got["a"]["pct"] == 66.67 and got["a"]["sample_size"] == 5 and got["a"]["total_rows"] == 6
    empty = rec.limit(0)
    assert stats.type_stats(empty).count() == 0
    assert stats.record_kpis(empty).first().asDict() == {
        "total_records": 0, "training_records": 0, "testing_records": 0,
        "training_percentage": 0.0, "testing_percentage": 0.0,
    }


def test_flatten_precedence(spark):
    m = decode_records(log_of(spark, ['{"id":"own","T":"mine","v":"1"}', '{"v":"2"}'], ["training", None]))
    first, second = [r["row"] for r in grid.flatten_records(m).orderBy("id").collect()]
    assert first == {"id": "own", "v": "1", "T": "training", "upload_timestamp": "2025-01-02 03:04:05"}
    assert second == {"id": "2", "v": "2", "upload_timestamp": "2025-01-02 03:04:05"}


def test_search_ignores_case_and_nulls(spark):
    m = decode_records(log_of(spark, ['{"a":"Hello"}', '{"a":null}', '{"b":"x"}']))
    assert [r["id"] for r in grid.search_any(m, "ELL").collect()] == [1]
    assert grid.search_any(m, "null").count() == 0


def test_parse_lines(spark):
    df = spark.createDataFrame([("1, a ,x",), ("1",), ("  ",), ("1,,z",)], "line string")
    got = [(r["data"], r["error"]) for r in grid.parse_lines(df, "line", ["p", "q"]).collect()]
    assert got[0][0] == {"p": "1", "q": "a"} and got[0][1] is None
    assert got[1] == (None, "Invalid format. Use: p, q") and got[2][0] is None
    assert got[3][0] == {"p": "1", "q": ""}


def test_keys_that_differ_by_case_stay_apart(spark):
    assert column_names(["type", "TYPE", "x"]) == ["type", "TYPE__2", "x"]
    m = decode_records(log_of(spark, ['{"type":"1","label":"0"}', '{"TYPE":"2","label":"1"}']))
    rows = records_to_features(m).orderBy("id").collect()
    assert [(r["type"], r["TYPE__2"]) for r in rows] == [("1", None), (None, "2")]
    with pytest.raises(ValueError):
        records_to_features(decode_records(log_of(spark, ['{"a":1}'])))


def test_score_requests_from_lists_and_lines(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"dur": 1.5, "proto": "tcp"},\n {"dur": 2}]')
    (tmp_path / "one.json").write_text('{"dur":\n 3}')
    got = sorted(r["data"]["dur"] for r in read_score_requests(spark, str(tmp_path), lines=False).collect())
    assert got == ["1.5", "2", "3"]
    path = fresh_path(spark, "lines")
    spark.createDataFrame([('{"dur":1}',), ("",)], "v string").write.text(path)
    assert [r["data"] for r in read_score_requests(spark, path).collect()] == [{"dur": "1"}]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "lines.json").write_text('{"dur":1}\n{"dur":2}{"x":1}\n\n[7]\n')
    rows = read_score_requests(spark, str(tmp_path / "bad")).collect()
    assert sorted((r["data"] is None, r["error"] is None) for r in rows) == [(False, True), (True, False), (True, False)]


def test_nothing_may_follow_the_object(spark):
    texts = ['{"a":1}{"b":2}', '{"a":1}, }', '{"a":1} junk}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', '[{"a":1}]', "null", "", ' {"a":[1,{"b":2}]} ']
    out = decode_records(log_of(spark, texts), "skip").collect()
    assert [(r["id"], r["data"]) for r in out] == [(9, {"a": '[1,{"b":2}]'})]
