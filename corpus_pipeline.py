"""The corpus pipeline: five stages, each one of the corpus operators, applied one after the other.

Each stage works on all that its predecessor kept. A row is a document: rows that repeat an id are not one document
unless their texts are equal too. Extra columns, whatever their names, are left out. Intermediate tables are deleted
when their stage is done, a stage's output when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import decontaminate, jaccard, language, lines, mixing
from barspark.llm.common import materialize, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; null and empty texts and texts without a letter go."""
    return language.known_language(docs.select(*COLUMNS))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common lines go from the later document; a document of which nothing else was left goes too.

    Rows that repeat id and text are treated alike, so both stay or both are cut; n_chars follows a cut text.
    """
    cut = lines.dedup_lines(docs.select(*COLUMNS))
    left = cut.where((F.col("n_deleted") == 0) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of the smallest id, and rows that repeat it.

    Documents without a word and those without an id are no one's duplicates and stay.
    """
    return jaccard.keep_one(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay; null and empty texts hold none."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; nothing of a null text, which has size 0."""
    with scratch(spark):
        return materialize(mixing.mix(docs).taken(), outer=True)


STAGES = [
    ("language id", identify_language),
    ("line dedup", deduplicate_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources", mix_sources),
]

#: Language identification is a fitted model, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
