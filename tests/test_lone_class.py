"""Balancing against its SQL where one class has no row, or the positives are the larger one."""

from __future__ import annotations

import duckdb
import pytest

from barspark.operators import splits
from barspark.plans.catalog import ORACLE, QUERIES
from tests import compare


@pytest.fixture(params=["no positives", "more positives", "no rows"])
def tables(request, tmp_path, monkeypatch):
    value = "power(4, i % 24)" if request.param == "more positives" else "1.0"
    rows = 0 if request.param == "no rows" else 48
    duckdb.connect().execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, ({value})::DOUBLE AS value, '' AS props FROM range({rows}) r(i)) TO '{tmp_path}/events.parquet'")
    monkeypatch.setattr(compare, "SF", str(tmp_path))


@pytest.mark.parametrize("name", ["balanced_weights", "downsample_majority", "downsample_negatives"])
def test_queries_follow_their_sql(spark, tables, name):
    compare.same_rows(spark, QUERIES[name], ORACLE[name])


def test_weights_of_a_lone_class(spark):
    df = spark.createDataFrame([(0,), (0,), (None,)], "y int")
    weights = lambda **k: [r["weight"] for r in splits.balanced_weights(df, "y", **k).orderBy("y").collect()]
    assert weights() == [None, 1.0, 1.0] and weights(classes=2) == [None, 0.5, 0.5]


def test_a_lone_class_is_kept_or_cut(spark):
    df = spark.createDataFrame([(i, 0) for i in range(5)], "k int, y int")
    assert splits.downsample(df, "y", ["k"]).count() == 5 and splits.downsample(df, "y", ["k"], lone=False).count() == 0
    assert splits.downsample(df, "y", ["k"], only_negatives=True, lone=False).count() == 0
