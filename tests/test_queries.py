"""Every registered query against its SQL twin, on the smallest tables."""

import re

import duckdb
import pytest
from pyspark.sql.types import IntegralType

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(map(str, r)) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    got = frame.toPandas()
    for f in frame.schema:  # pandas makes whole numbers with a null among them floating
        if isinstance(f.dataType, IntegralType):
            got[f.name] = got[f.name].astype("Int64")
    want = duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_contract():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 75
    without = {n for n in set(QUERIES) - set(ORACLES) if not re.match(r"op\d+_|pipeline$", n)}
    assert not without


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def test_stream_reads_a_folder_of_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    n = QUERIES["predict_records"](spark, sf).count()
    assert QUERIES["predict_stream"](spark, str(tmp_path)).count() > n > 0
