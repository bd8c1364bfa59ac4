"""MERGE that rewrites only the partitions it changes."""

from __future__ import annotations

from pathlib import Path

import pytest

from barspark.sources.bars import merge_into

SCHEMA = "day string, k int, v string"


def files(path: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in Path(path).rglob("*.parquet"):
        out.setdefault(f.parent.name, []).append(f.name)
    return {k: sorted(v) for k, v in out.items()}


def rows(spark, path):
    return sorted((str(r["day"]), r["k"], r["v"]) for r in spark.read.schema(SCHEMA).parquet(path).collect())


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    merge_into(path, make([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 9, None)]), ["day", "k"], ["day"])
    before = files(path)
    touched = merge_into(path, make([("a", 2, "new"), ("a", 3, "more"), ("d", 1, "first")]), ["day", "k"], ["day"])
    after = files(path)
    assert sorted(r["day"] for r in touched) == ["a", "d"]
    assert rows(spark, path) == [("a", 1, "x"), ("a", 2, "new"), ("a", 3, "more"), ("b", 1, "z"), ("c", 9, None), ("d", 1, "first")]
    assert after["day=b"] == before["day=b"] and after["day=c"] == before["day=c"] and after["day=a"] != before["day=a"]
    assert merge_into(path, make([]), ["day", "k"], ["day"]) == [] and files(path) == after


def test_a_source_that_stands_on_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge_into(path, spark.createDataFrame([("a", 1, "x"), ("b", 1, "z")], SCHEMA), ["day", "k"], ["day"])
    merge_into(path, spark.read.schema(SCHEMA).parquet(path).where("day = 'a'").selectExpr("day", "k", "v || '!' AS v"), ["day", "k"], ["day"])
    assert rows(spark, path) == [("a", 1, "x!"), ("b", 1, "z")]


def test_errors_leave_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge_into(path, spark.createDataFrame([("a", 1, "x")], SCHEMA), ["day", "k"], ["day"])
    before = files(path)
    for bad, why in (([("a", 2, "p"), ("a", 2, "q")], "repeats"), ([(None, 2, "p")], "no partition")):
        with pytest.raises(ValueError, match=why):
            merge_into(path, spark.createDataFrame(bad, SCHEMA), ["day", "k"], ["day"])
    with pytest.raises(ValueError, match="partitioned"):
        merge_into(path, spark.createDataFrame([], SCHEMA), ["k"], ["day"])
    assert files(path) == before and rows(spark, path) == [("a", 1, "x")]
