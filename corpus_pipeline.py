"""A corpus from documents in five stages; each writes what the next one reads.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of documents.
A null or empty text fails the quality rules, so later stages see texts with words; texts may become empty
when all of their bytes repeat, and such rows stay. Repeated rows are copies of one document: the second stage
keeps the rows of the smallest doc_id of a group. Empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, mixing, near_dup, quality, repeats
from rivulet.session import fresh_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# The bisection of the exponent and the suffix array have no SQL twin; tests/llm/test_pipeline.py runs brute force instead.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.clean_lines(docs.select(*COLUMNS)).where("kept")
    return _documents(judged.withColumn("text", F.col("clean_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs, words_per_shingle=5)


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(repeats.cut_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, near_duplicates, suffix_repeats, decontamination, source_mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
