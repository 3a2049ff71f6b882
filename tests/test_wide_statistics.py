"""Preparation of large flow tables: rows in one piece are dealt, statistics taken a few columns at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift import session
from flowsift.fixtures import view
from flowsift.operators import flows, prep
from flowsift.plans.offline import prepare_matrix


def test_a_large_input_in_one_piece_is_dealt(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "SMALL_BYTES", 1)  # every input counts as large
    monkeypatch.setattr(session, "MAX_PIECES", 4)
    raw = flows.rename_headers(view(spark, sf, "fx_raw_flows")).coalesce(1)
    matrix = prepare_matrix(raw).matrix
    pieces = [r["count"] for r in matrix.groupBy(F.input_file_name()).count().collect()]
    assert len(pieces) == 8 and sum(pieces) == 1000 and max(pieces) < 200  # the test session has 8 cores


@pytest.mark.parametrize("at_once", [1, 3])
def test_medians_and_moments_in_passes_over_few_columns(spark, monkeypatch, at_once):
    monkeypatch.setattr(prep, "COLUMNS_AT_ONCE", at_once)
    rng = random.Random(3)
    rows = [[rng.choice([None, rng.randrange(50) / 4, rng.random()]) for _ in range(4)] + [None] for _ in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, `c.d` double, e double, f double").withColumnRenamed("c.d", "c")
    got = prep.exact_medians(df, ["a", "b", "c", "e", "f"], small=20)
    moments = prep.fit_scaler(df, ["a", "b", "c", "e"]).first()
    for i, c in enumerate("abce"):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == pytest.approx(float(np.median(values)))
        assert moments[c]["mean"] == pytest.approx(np.mean(values)) and moments[c]["std"] == pytest.approx(np.std(values))
    assert got["f"] is None
