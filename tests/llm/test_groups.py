"""Sharding, pair operators and the pipeline against brute force."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowsift.llm import components, jaccard, langid, packing, pivots, quality, sharding
from flowsift.llm.queries import QUERIES, TOKENIZER


def check_shards(rows, shards, whole=None):
    load, slots, of = [0] * shards, {}, {}
    for r in rows:
        load[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        of.setdefault(r.k, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load, of


def test_shards_balance_and_groups(spark):
    rows = [(i, f"k{i % 300:03d}", 10 + i % 7) for i in range(6000)] + [(i, "hot", 9) for i in range(3000)]
    rows += [(7, "same", 8)] * 2000 + [(None, None, 50), (1, "big", 9000)]
    df = spark.createDataFrame(rows, "id long, k string, size long").repartition(7).withColumn("slot", F.lit("old"))
    out = sharding.assign_shards(df, F.col("k"), F.col("id"), F.col("size"), 8)
    got = out.collect()
    load, of = check_shards(got, 8)
    assert len(got) == len(rows) and set(out.columns) == {"id", "k", "size", "shard", "slot", "shard_bytes_before"}
    mean = sum(load) / 8
    assert max(load) <= mean * 1.07 + 9000 and min(load) >= mean * 0.93 - 9000
    assert all(len(s) == 1 for k, s in of.items() if k not in ("hot", "same"))
    assert len(of["hot"]) > 1
    assert sharding.assign_shards(df.limit(0), F.col("k"), F.col("id"), F.col("size"), 8).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    linked = np.zeros((len(rows), len(rows)), bool)
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        linked[i, j] = linked[j, i] = common > 0 and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common)
    return linked


def brute_rows(ids, linked):
    label = list(range(len(ids)))
    for _ in ids:
        label = [min([label[i], *(label[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(ids))]
    group = {}
    for i, g in enumerate(label):
        if ids[i] is not None:
            group[g] = min(group.get(g, ids[i]), ids[i])
    return sorted((ids[i] if ids[i] is not None else -1, int(linked[i].sum()), -1 if group.get(label[i]) is None else group[label[i]]) for i in range(len(ids)))


def near_texts(seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (4, 6, 12, 40, 120):
        for _ in range(6):
            base = list(rng.choice(words, size))
            for edits in (0, 0, 1, 2, 3, 5):
                text = base.copy()
                for at in rng.integers(0, size, edits):
                    text[at] = str(rng.choice(words))
                rows.append((n, " ".join(text)))
                n += 1
    passage = " ".join(rng.choice(words, 60))
    for _ in range(40):
        rows.append((n, f"{' '.join(rng.choice(words, 20))} {passage}"))
        n += 1
    return rows


def test_jaccard_equals_brute_force(spark):
    rows = near_texts() + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (903, "one two"), (None, "one\ttwo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(5)
    want = brute_rows([r[0] for r in rows], brute_join(rows))
    for forest in (jaccard.Forest(), jaccard.Forest(block=8), jaccard.Forest(block_bytes=200)):
        out = jaccard.jaccard_join(df, "doc_id", "text", forest).collect()
        pick = lambda x: -1 if x is None else x
        assert sorted((pick(r.doc_id), r.n_links, pick(r.component_id)) for r in out) == want
    assert jaccard.jaccard_join(df.limit(0), "doc_id", "text").count() == 0


def test_jaccard_blocks_without_a_text_count_nothing_again(spark):
    rows = []
    for g in range(24):
        words = [f"g{g}w{i}" for i in range(60)]
        near = [*words[:59], f"g{g}x"]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(near))]
        if g % 2:  # and one of the next size class
            rows.append((10 * g + 2, " ".join([*words, *(f"g{g}y{i}" for i in range(8))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_rows([r[0] for r in rows], brute_join(rows))
    for size in (200, 300, 500):
        out = jaccard.jaccard_join(df, "doc_id", "text", jaccard.Forest(block_bytes=size)).collect()
        assert sorted((r.doc_id, r.n_links, r.component_id) for r in out) == want


def test_forest_depth_follows_the_target():
    assert jaccard.Forest().prefix == 7
    assert jaccard.Forest(tries=8, target=0.99).prefix < 7
    with pytest.raises(ValueError):
        _ = jaccard.Forest(tries=1, target=0.9999).prefix


def test_keep_representatives(spark):
    rows = near_texts(4)[:120] + [(500, "a b c d e f g"), (500, "a b c d e f g"), (501, None), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own_key", F.lit("clash"))
    kept = jaccard.keep_representatives(df, "doc_id", "text")
    assert kept.columns == df.columns
    want = {c for _, _, c in brute_rows([r[0] for r in rows], brute_join(rows))} | {501, 502}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted(want)


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(600, 32))
    x = [v.tolist() for v in base]
    for i in range(200):  # around the threshold
        x.append((base[i % 40] + rng.normal(size=32) * rng.uniform(0.01, 0.5)).tolist())
    x += [(base[0] * 2).tolist(), base[1].tolist()]
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 32), (5002, [None] + [1.0] * 31), (5003, [float("nan")] * 32), (5004, []), (5005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("points", F.lit(1))
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    for index in (pivots.Index(), pivots.Index(block=40)):
        got = {r.vec_id: r for r in pivots.near_vectors(df, "vec_id", "embedding", index).collect()}
        assert len(got) == len(rows)
        found = sum(got[i].n_links for i in range(len(x)))
        assert all(got[i].n_links <= linked[i].sum() for i in range(len(x)))
        assert found >= 0.9 * linked.sum()
        for i in (5000, 5001, 5002, 5003, 5004, 5005):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pivots.near_vectors(df.limit(0), "vec_id", "embedding").count() == 0


def hot_cluster(n=20_000, dim=64, cosine=0.955):
    """Distinct unit vectors, a third of them around one direction with about this cosine to each other."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(1, dim))
    hot = centre / np.linalg.norm(centre) + rng.normal(size=(n // 3, dim)) * np.sqrt((1 / cosine - 1) / dim)
    x = np.concatenate([hot, rng.normal(size=(n - n // 3, dim))])
    x[-500:] = x[n // 3 : n // 3 + 500] + rng.normal(size=(500, dim)) * 0.2
    return (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(n)]


def test_near_vectors_in_a_hot_cluster(spark):
    x = hot_cluster()
    want = np.concatenate([(x[i : i + 2000] @ x.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(x), 2000)])
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))})
    got = np.zeros(len(x), np.int64)
    for r in pivots.near_vectors(spark.createDataFrame(table).repartition(8), "vec_id", "embedding").collect():
        got[r.vec_id] = r.n_links
    assert (got <= want).all()
    assert got.sum() >= 0.98 * want.sum()
    many = want >= 50
    assert many.any() and (got[many] / want[many]).min() >= 0.9


def test_lists_hold_each_pair_once():
    rng = np.random.default_rng(4)
    for n_pivots, k, shared in ((1, 1, 2), (4, 4, 2), (7, 5, 2), (12, 10, 2), (40, 10, 2), (40, 10, 3)):
        points = np.array([rng.permutation(n_pivots)[:k] for _ in range(60)])
        lists = [set(map(int, row)) for row in pivots.entered(points, n_pivots, shared)]
        for i, j in itertools.combinations(range(60), 2):
            both = set(map(int, points[i])) & set(map(int, points[j]))
            if len(both) >= min(shared, k):
                assert min(both) in lists[i] and min(both) in lists[j]


def test_blocks_without_a_vector_count_nothing_again(spark):
    rows = [(i, [1.0, i / 1000]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (1, 2, 3):
        got = pivots.near_vectors(df, "vec_id", "embedding", pivots.Index(block=block)).collect()
        assert [r.n_links for r in got] == [7] * 8


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {d for d, r in rows.items() if quality.measure(r.text, quality.Bands())[-1]}
    first = corpus_pipeline.keep_good(spark, docs, sf)
    assert {r.doc_id for r in first.select("doc_id").collect()} == good and first.columns == docs.columns
    second = corpus_pipeline.keep_known_language(spark, first, sf)
    known = sorted(r.doc_id for r in second.collect())
    assert set(known) <= good and len(known) >= 0.98 * len(good) and second.columns == docs.columns
    third = corpus_pipeline.keep_one_of_each_group(spark, second, sf)
    pairs = [(d, rows[d].text) for d in known]
    want = {c for _, _, c in brute_rows(known, brute_join(pairs))}
    assert {r.doc_id for r in third.collect()} == want and third.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == want
    last = sorted(out, key=lambda r: (r.sequence_id, r.offset))
    assert sum(r.length for r in last[:-1]) + last[-1].length == last[-1].sequence_id * packing.WINDOW + last[-1].offset + last[-1].length


def test_pipeline_takes_odd_and_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit("clash"))
    odd = docs.limit(0).unionByName(
        spark.createDataFrame([(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "y")], docs.schema)
    )
    for start in (docs.limit(0), odd):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns and now.count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == 0
    assert TOKENIZER and langid and QUERIES
