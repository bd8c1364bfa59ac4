from __future__ import annotations

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm.queries import ORACLE, QUERIES
from tests.compare import SF, same_rows
from tests.llm.test_operators import awkward


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same_rows(spark, name):
    same_rows(spark, QUERIES[name], ORACLE[name])


def test_pipeline(spark):
    """Every stage by its operator's rule on its own input; the end is the mix of what was kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert set(out.columns) == set(docs.columns)
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    got = {r["doc_id"]: r["size"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, ties and clashing columns through each stage, then an empty table."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, "w1 x1"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = awkward(spark).withColumn("_gone", F.lit(0)).withColumn("_n", F.lit(1)).withColumn("__row_key", F.lit("k")).withColumn("kept", F.lit(False))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.collect())
    got = {name: stage(spark, docs, str(tmp_path)) for name, stage in stages.items()}
    assert all(got[name].columns == corpus_pipeline.COLUMNS for name in list(stages)[:-1])
    assert set(ids(got["language id"])) <= {-1, 3, 4, 6} and not {1, 2, 5} & set(ids(got["language id"]))
    assert ids(got["line dedup"]) == [-1, 1, 2, 3, 4, 4, 5, 6]  # nothing is shared but by rows that repeat each other
    assert ids(got["n-gram Jaccard join"]) == [-1, 1, 2, 3, 4, 4, 5, 6]
    assert ids(got["benchmark decontamination"]) == [-1, 1, 2, 5, 6]
    sizes = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["size"]) for r in got["mixing sources"].collect())
    assert sizes == [(-1, 6), (1, 0), (2, 0), (3, 120_000), (4, 13), (4, 13), (5, 1), (6, 5)]
    empty = spark.createDataFrame([], docs.schema)
    assert [stage(spark, empty, str(tmp_path)).count() for stage in stages.values()] == [0] * 5
