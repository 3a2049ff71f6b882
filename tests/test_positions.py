import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from flowsift import session
from flowsift.operators import metrics, position, sample, split
from flowsift.session import written


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long").repartition(5)


CLUSTERED = sorted(set(range(1000)) | {10**9 + i * i for i in range(500)} | {10**15})


@pytest.mark.parametrize("values", [list(range(7, 500)), CLUSTERED, [42]])
@pytest.mark.parametrize("bucket_rows", [40, 10**6])
def test_dense_position(spark, values, bucket_rows):
    got = {
        r["id"]: r["position"]
        for r in position.dense_position(keys(spark, values), "id", bucket_rows=bucket_rows).collect()
    }
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_clustered_keys_do_not_share_a_bucket(spark):
    df = keys(spark, CLUSTERED)
    span = position.key_range(df, F.col("id"))
    bucket = position.bucket_of(df, F.col("id"), span, 50)
    sizes = [r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()]
    assert max(sizes) < len(CLUSTERED) / 2


def test_prefix_sums_descending(spark):
    rng = random.Random(1)
    rows = [(float(s), rng.randrange(9)) for s in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "s double, w long").repartition(6)
    got = {
        r["s"]: r["above"]
        for r in position.prefix_sums(df, -F.col("s"), {"above": F.col("w")}, bucket_rows=30).collect()
    }
    assert got == {s: sum(w for t, w in rows if t > s) for s, _ in rows}


def test_number_rows_follows_a_sort(spark):
    ordered = spark.range(1000).orderBy(F.desc("id"))
    got = {r["id"]: r["position"] for r in position.number_rows(ordered).collect()}
    assert got == {i: 1000 - i for i in range(1000)}


@pytest.mark.parametrize("values", [list(range(1, 101)), CLUSTERED[:300]])
def test_pages_concatenate_to_the_table(spark, values):
    df, out, offset = keys(spark, values), [], 0
    while True:
        got = position.page(df, 40, offset, bucket_rows=16)
        rows, info = [r["id"] for r in got.rows.collect()], got.info.first()
        assert len(rows) == info["returned_rows"] and info["total_rows"] == len(values)
        out += rows
        offset += 40
        if not info["has_more"]:
            break
    assert out == sorted(values)


def test_page_limits(spark):
    df = keys(spark, range(1, 3001))
    info = position.page(df, 0, -5).info.first()
    assert (info["limit"], info["offset"], info["returned_rows"]) == (1000, 0, 1000)
    assert position.page(df, 5000, 0, default=100, cap=1000).info.first()["returned_rows"] == 1000
    past = position.page(df, 10, 9999)
    assert past.rows.count() == 0 and not past.info.first()["has_more"]
    assert position.page(df.limit(0), 10, 0).rows.count() == 0


def test_rows_at_repeats_rows_of_overlapping_ranges(spark):
    for values in (list(range(1, 51)), CLUSTERED[-60:]):
        got = position.rows_at(keys(spark, values), "id", [(0, 5), (3, 4)], bucket_rows=9).collect()
        assert sorted((r["block"], r["id"]) for r in got) == sorted(
            [(0, v) for v in values[:5]] + [(1, v) for v in values[3:7]]
        )


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 4), (10, 16), (999, 1), (2000, 4)])
def test_split_sizes_and_stability(spark, n, parts):
    df = spark.range(1, n + 1).repartition(parts)
    got = {r["id"]: r["T"] for r in split.assign_split(df, 0.3, 7).collect()}
    assert len(got) == n and sum(t == "training" for t in got.values()) == int(n * 0.3)
    again = {r["id"]: r["T"] for r in split.assign_split(spark.range(1, n + 1), 0.3, 7).collect()}
    assert got == again


def test_cut_descends_through_prefixes(spark, monkeypatch):
    df = spark.range(3000)
    plain = {r["id"] for r in split.assign_split(df, 0.3, 3).where("T = 'training'").collect()}
    monkeypatch.setattr(split, "SMALL", 0)
    monkeypatch.setattr(split, "PREFIX_STEP", 1)
    assert {r["id"] for r in split.assign_split(df, 0.3, 3).where("T = 'training'").collect()} == plain


def test_split_summary(spark):
    got = split.split_summary(split.assign_split(spark.range(7), 0.3)).first()
    assert tuple(got) == (7, 2, 5, 28.57, 71.43)
    assert tuple(split.split_summary(spark.createDataFrame([], "T string")).first()) == (0, 0, 0, 0.0, 0.0)


def test_published_split_sizes(spark):
    counts = spark.createDataFrame([(0, 37_000), (1, 45_332)], "_g int, _c long")
    assert split.allocate(counts, 0.2).agg(F.sum("_k")).first()[0] == 16_467
    assert int(82_332 * 0.3) == 82_332 - 57_633


@pytest.mark.parametrize("shares", [{0: 10, 1: 90}, {0: 3, 1: 3, 2: 5}, {0: 1, 1: 999}])
def test_stratified_split(spark, shares):
    rows = [(i, y) for i, y in enumerate(y for y, c in shares.items() for _ in range(c))]
    df = spark.createDataFrame(rows, "id long, y int").repartition(3)
    got = split.stratified_split(df, "y", 0.2, 42).where("split = 'test'").groupBy("y").count().collect()
    n, taken = sum(shares.values()), {r["y"]: r["count"] for r in got}
    assert sum(taken.values()) == math.ceil(0.2 * n)
    assert all(abs(taken.get(y, 0) - 0.2 * c) < 1 for y, c in shares.items())


def test_block_offsets_rule():
    assert sample.block_offsets(10_000, 10_000, 1_000, 50) == [(0, 10_000)]
    offsets = [o for o, _ in sample.block_offsets(587_000, 10_000, 1_000, 50)]
    assert len(offsets) == 50 and offsets[0] == 0 and offsets[-1] == 586_000
    assert offsets[1] == 587_000 // 49


def test_block_sample_counts_overlaps_twice_unless_deduped(spark):
    df = spark.range(1, 106)
    twice = sample.block_sample(df, 50, 10, 50)
    assert twice.count() == 100
    once = sample.block_sample(df, 50, 10, 50, dedupe=True)
    assert once.count() == once.select("id").distinct().count()


def test_type_sample_bounds(spark):
    rows = [(i, None, None, {"type": "hot" if i % 3 else f"t{i % 5}"}) for i in range(600)]
    m = spark.createDataFrame(rows, "id long, upload_timestamp timestamp, T string, data map<string,string>")
    got = sample.type_sample(m, k=15, limit=100).collect()
    per_type = {}
    for r in got:
        per_type[r["type"]] = per_type.get(r["type"], 0) + 1
    assert set(per_type.values()) == {15} and len(per_type) == 6
    assert [(r["type"], r["id"]) for r in got] == sorted((r["type"], r["id"]) for r in got)
    plan = sample.type_sample(m)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_labels_without_a_shuffle(spark):
    assert "Exchange" not in plan_of(split.assign_split(spark.range(1000), 0.3, 7))


def test_deep_page_is_an_id_range_on_the_scan(spark):
    ids = written(spark.range(1, 1001), "ids")
    plan = plan_of(position.rows_at(ids, "id", [(500, 10)]))
    assert "GreaterThanOrEqual(id,501)" in plan and "LessThan(id,511)" in plan
    assert "Window" not in plan and "Exchange" not in plan


def test_small_inputs_only_are_spread(spark, monkeypatch):
    ids = written(spark.range(100).coalesce(1), "ids")
    assert "Exchange RoundRobin" in plan_of(session.spread(ids))
    monkeypatch.setattr(session, "SMALL_BYTES", 0)
    assert "Exchange" not in plan_of(session.spread(ids))


def test_every_threshold_has_a_row_without_input(spark):
    empty = spark.createDataFrame([], "y int, score double")
    assert [tuple(r)[1:] for r in metrics.threshold_sweep(empty).collect()] == [(0.0, 0.0, 0.0)] * 17


def test_null_keys_are_refused_on_both_paths(spark):
    df = spark.createDataFrame([(i if i % 5 else None,) for i in range(200)], "id long")
    for bucket_rows in (10, 10_000):
        with pytest.raises(ValueError, match="40 rows have no key"):
            position.dense_position(df, "id", bucket_rows=bucket_rows)
    scores = df.select(F.col("id").cast("double").alias("score"), F.lit(1).alias("y"))
    for bucket_rows in (10, 10_000):
        with pytest.raises(ValueError, match="no key"):
            metrics.ranking_metrics(scores, bucket_rows=bucket_rows)


def test_stratified_split_of_double_labels(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 1e7).otherwise(1e-4).alias("label"))
    out = split.stratified_split(df, "label").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in out} == {
        (1e7, "test"): 20, (1e7, "train"): 80, (1e-4, "test"): 40, (1e-4, "train"): 160,
    }
    with pytest.raises(ValueError, match="1 rows have no label"):
        split.stratified_split(df.unionByName(spark.createDataFrame([(999, None)], "id long, label double")), "label")


def test_two_blocks_reach_the_end(spark):
    blocks = sample.block_sample(spark.range(1, 2501), 1000, 1000, 50)
    assert blocks.agg(F.max("id")).first()[0] == 2500


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_stratified_split_of_many_classes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(split, "BROADCAST_CLASSES", broadcast)
    monkeypatch.setattr(split, "SMALL", 500)
    own = F.when(F.col("id") < 20_000, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.floor(F.col("id") / 2).cast("string")))
    df = spark.range(80_000).select("id", own.alias("y"), F.lit("kept").alias("_x"))
    out = split.stratified_split(df, "y", 0.25, 3)
    assert out.columns == ["id", "y", "_x", "split"]
    rows = out.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("k")).collect()
    assert sum(r.n for r in rows) == 80_000 and sum(r.k for r in rows) == 20_000 and len(rows) == 30_001
    want = {}
    for r in rows:  # largest remainder, in whole numbers
        want[r.y] = divmod(60_000 * r.n, 80_000)
    more = 60_000 - sum(q for q, _ in want.values())
    lucky = set(sorted(want, key=lambda y: (-want[y][1], y))[:more])
    assert all(r.k == r.n - want[r.y][0] - (r.y in lucky) for r in rows)
    hot = sorted((hashlib.md5(f"3:{i}".encode()).hexdigest(), i) for i in range(20_000))
    chosen = {r.id for r in out.where("y = 'hot' AND split = 'test'").collect()}
    assert chosen == {i for _, i in hot[: len(chosen)]}
